"""The same results in DuckDB SQL over the given tables."""

_FILES = """
docs AS (SELECT *, concat(source, '/', lang, '/doc_', doc_id, CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md'
    WHEN 2 THEN '.log' WHEN 3 THEN '.tmp' ELSE '.bin' END) AS rel_path FROM documents),
src_files AS (SELECT rel_path, 'regular' AS file_type, CAST(strlen(text) AS BIGINT) AS size,
    1704067200000000000 + doc_id * 1000000000 AS mtime_ns,
    CAST(CASE WHEN doc_id % 6 = 0 THEN 384 ELSE 420 END AS INTEGER) AS mode, 1000 + doc_id % 3 AS uid,
    CAST(100 AS BIGINT) AS gid, CAST(1 AS BIGINT) AS dev,
    doc_id - CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END AS ino,
    CAST(CASE WHEN doc_id % 50 IN (0, 1) THEN 2 ELSE 1 END AS BIGINT) AS nlink, encode(text) AS content FROM docs),
dst_bodies AS (SELECT rel_path, doc_id, CASE WHEN doc_id % 10 = 2
        THEN concat(substring(text, 1, length(text) // 2), '@@', substring(text, length(text) // 2 + 1))
        WHEN doc_id % 10 IN (3, 4) THEN concat('#', substring(text, 2)) ELSE text END AS body,
    1704067200000000000 + doc_id * 1000000000 + CASE doc_id % 10 WHEN 1 THEN 1 WHEN 2 THEN -1000000000
        WHEN 3 THEN -1000000000 ELSE 0 END AS mtime_ns FROM docs WHERE doc_id % 10 <> 0
    UNION ALL SELECT concat('stale/', page_id % 7, '/page_', page_id, '.html'), page_id, html,
        1704067200000000000 + page_id * 1000000000 FROM pages),
dst_files AS (SELECT rel_path, 'regular' AS file_type, CAST(strlen(body) AS BIGINT) AS size, mtime_ns,
    CAST(420 AS INTEGER) AS mode, CAST(1000 AS BIGINT) AS uid, CAST(100 AS BIGINT) AS gid, CAST(1 AS BIGINT) AS dev,
    doc_id + 1000000 AS ino, CAST(1 AS BIGINT) AS nlink, encode(body) AS content FROM dst_bodies)"""


def _tree(name):
    return f"""{name} AS (SELECT * EXCLUDE (content) FROM {name}_files UNION ALL
    SELECT DISTINCT array_to_string(string_split(rel_path, '/')[1:k], '/'), 'dir', CAST(0 AS BIGINT), CAST(0 AS BIGINT),
        CAST(493 AS INTEGER), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST(1 AS BIGINT)
    FROM (SELECT rel_path, unnest(range(1, len(string_split(rel_path, '/')))) AS k FROM {name}_files))"""


_TREES = f"{_FILES}, {_tree('src')}, {_tree('dst')}"

_EV = """
ev AS (SELECT concat('run', user_id % 4) AS run_id, ts, event_id AS seq,
    CASE event_type WHEN 'view' THEN CASE WHEN event_id % 8 = 3 THEN 'FileProgress' ELSE 'FileStarted' END
           WHEN 'click' THEN 'FileCompleted' WHEN 'error' THEN 'FileFailed'
           WHEN 'signup' THEN CASE event_id % 8 WHEN 0 THEN 'DirCreated' WHEN 1 THEN 'HardlinkCreated' WHEN 2 THEN 'DeleteFile'
             ELSE 'FileSkipped' END
           ELSE CASE event_id % 8 WHEN 0 THEN 'VerifyOK' WHEN 1 THEN 'VerifyStarted' WHEN 2 THEN 'ScanComplete'
             WHEN 3 THEN 'ScanStarted' ELSE 'VerifyFailed' END END AS type,
    concat('/dst/', user_id, '/f_', event_id) AS path, CAST(round(value * 100) AS BIGINT) AS size,
    CAST(user_id % 8 AS INTEGER) AS worker, CASE WHEN event_type = 'error' THEN 'io error' END AS error,
    CASE WHEN event_type = 'purchase' AND event_id % 8 = 2 THEN event_id END AS total,
    CASE WHEN event_type = 'purchase' AND event_id % 8 = 2 THEN event_id * 1000 END AS total_size FROM events)"""


def _keep(a=""):
    """The sample rule chain."""
    return f"""(({a}file_type = 'dir' OR {a}size >= 64) AND
      CASE WHEN regexp_matches({a}rel_path, '^(.*/)?[^/]*\\.md$') THEN true
           WHEN regexp_matches({a}rel_path, '(^|/)[^/]*\\.tmp$') THEN false
           WHEN {a}file_type = 'dir' AND regexp_matches({a}rel_path, '(^|/)src1$') THEN false ELSE true END)"""


def _pruned(a=""):
    return f"regexp_matches({a}rel_path, '(^|/)src1/')"


def _links(where):
    return f"""(SELECT rel_path, min(rel_path) OVER (PARTITION BY dev, ino) AS first_path FROM src s
      WHERE file_type = 'regular' AND nlink > 1 AND {where})"""


def _plan(delete=True, hardlinks=True, name="plan"):
    gone = "CASE WHEN d.file_type = 'dir' THEN 'delete_dir' ELSE 'delete_file' END" if delete else "'keep'"
    candidates = _links(f"""{_keep('s.')} AND NOT {_pruned('s.')} AND NOT EXISTS (SELECT 1 FROM dst d
      WHERE d.rel_path = s.rel_path AND d.size = s.size AND d.mtime_ns = s.mtime_ns)""")
    links = candidates if hardlinks else "(SELECT rel_path, rel_path AS first_path FROM src)"
    return f"""
links AS (SELECT * FROM {links} WHERE rel_path <> first_path),
{name} AS (SELECT coalesce(s.rel_path, d.rel_path) AS rel_path,
  CASE WHEN s.rel_path IS NULL AND NOT {_keep('d.')} THEN 'excluded' WHEN s.rel_path IS NULL THEN {gone}
       WHEN NOT {_keep('s.')} OR {_pruned('s.')} THEN 'excluded' WHEN s.file_type = 'dir' THEN 'mkdir'
       WHEN s.size = d.size AND s.mtime_ns = d.mtime_ns THEN 'skip' WHEN l.first_path IS NOT NULL THEN 'hardlink'
       WHEN d.rel_path IS NULL THEN 'copy_new' ELSE 'copy_changed' END AS action,
  coalesce(s.file_type, d.file_type) AS file_type, coalesce(s.size, d.size) AS size,
  CASE WHEN s.rel_path IS NULL AND NOT {_keep('d.')} THEN 'protected' WHEN s.rel_path IS NULL THEN 'extraneous'
       WHEN NOT {_keep('s.')} THEN 'rule' WHEN {_pruned('s.')} THEN 'under excluded directory'
       WHEN d.rel_path IS NULL THEN 'new' WHEN s.file_type = 'regular' AND s.size <> d.size THEN 'size'
       WHEN s.file_type = 'regular' AND s.mtime_ns <> d.mtime_ns THEN 'mtime' ELSE 'same' END AS reason,
  l.first_path AS link_target, d.size AS basis_size
  FROM src s LEFT JOIN links l ON l.rel_path = s.rel_path FULL OUTER JOIN dst d ON d.rel_path = s.rel_path)"""


_VERIFY = f"""
v AS (SELECT rel_path, sha256(s.content) AS src_hash, sha256(d.content) AS dst_hash,
  CASE WHEN s.content = d.content THEN 'ok' ELSE 'mismatch' END AS status
  FROM dst_files d JOIN src_files s USING (rel_path) WHERE {_keep('d.')})"""


def _blocks(table, width, name):
    return f"""{name} AS (SELECT rel_path, CAST(b AS INTEGER) AS block_idx, b * w AS "offset", CAST(w AS INTEGER) AS block_size,
    content[b * w + 1 : (b + 1) * w] AS bytes, least(w, n - b * w) AS length
  FROM (SELECT *, unnest(range((n + w - 1) // w)) AS b FROM (SELECT rel_path, content, octet_length(content) AS n,
    {width} AS w FROM {table})))"""


_AUTO = "greatest(512, least(131072, CAST(floor(sqrt(octet_length(content))) AS BIGINT)))"

# Every window of every source file against the basis blocks, then a greedy walk by recursion.
_MATCH = f"""
basis AS (SELECT rel_path, content, octet_length(content) AS n, {_AUTO} AS w FROM dst_files WHERE octet_length(content) > 0),
bb AS (SELECT rel_path, b AS block_idx, w, least(w, n - b * w) AS len, content[b * w + 1 : (b + 1) * w] AS bytes
       FROM (SELECT *, unnest(range((n + w - 1) // w)) AS b FROM basis)),
uniq AS (SELECT rel_path, w, len, bytes, hash(bytes) AS h, min(block_idx) AS block_idx FROM bb GROUP BY ALL),
spans AS (SELECT s.rel_path, u.len, s.content, octet_length(s.content) - u.len AS last, CASE WHEN u.len = u.w THEN 0 ELSE octet_length(s.content) - u.len END AS first
         FROM src_files s JOIN (SELECT DISTINCT rel_path, w, len FROM uniq) u USING (rel_path) WHERE octet_length(s.content) >= u.len),
wins AS (SELECT rel_path, len, unnest(range(first, last + 1)) AS p, unnest(list_transform(range(first, last + 1), lambda q: hash(content[q + 1 : q + len]))) AS h FROM spans),
hits AS (SELECT DISTINCT m.rel_path, p, m.len, block_idx FROM (SELECT wins.rel_path, p, wins.len, block_idx, bytes
           FROM wins JOIN uniq USING (rel_path, len, h)) m JOIN src_files s USING (rel_path)
         WHERE s.content[p + 1 : p + m.len] = m.bytes),
nexts AS (SELECT a.rel_path, a.p, a.len, a.block_idx, b.p AS nx
          FROM hits a ASOF LEFT JOIN hits b ON a.rel_path = b.rel_path AND b.p >= a.p + a.len),
chain AS (WITH RECURSIVE walk AS (
    SELECT h.* FROM nexts h JOIN (SELECT rel_path, min(p) AS p FROM hits GROUP BY rel_path) f USING (rel_path, p)
    UNION ALL SELECT n.* FROM walk JOIN nexts n ON n.rel_path = walk.rel_path AND n.p = walk.nx) SELECT * FROM walk),
copies AS (SELECT rel_path, p AS pos, len, block_idx, lag(p + len, 1, 0) OVER (PARTITION BY rel_path ORDER BY p) AS prev_end FROM chain),
ends AS (SELECT s.rel_path, coalesce(max(pos + len), 0) AS prev_end, any_value(octet_length(s.content)) AS n
         FROM src_files s LEFT JOIN copies USING (rel_path) GROUP BY s.rel_path),
pieces AS (SELECT rel_path, pos, block_idx, len FROM copies
    UNION ALL SELECT rel_path, prev_end, -1, pos - prev_end FROM copies WHERE pos > prev_end
    UNION ALL SELECT rel_path, prev_end, -1, n - prev_end FROM ends WHERE n > prev_end),
ops AS (SELECT pieces.rel_path, row_number() OVER (PARTITION BY pieces.rel_path ORDER BY pos) - 1 AS seq, pos, block_idx,
    len, coalesce(w, 512) AS w FROM pieces LEFT JOIN basis USING (rel_path))"""

_TICKS = """
sums AS (SELECT run_id, epoch_us(ts) // 3600000000 AS tick,
    CAST(sum(CASE WHEN type IN ('FileCompleted', 'FileSkipped') THEN size ELSE 0 END) AS BIGINT) AS bytes,
    count(*) FILTER (type = 'FileCompleted') AS files FROM ev GROUP BY ALL),
spine AS (SELECT run_id, lo, unnest(range(lo, hi + 1)) AS tick
    FROM (SELECT run_id, min(tick) AS lo, max(tick) AS hi FROM sums GROUP BY run_id)),
ticks AS (SELECT run_id, tick, tick - lo AS idx, coalesce(bytes, 0) AS bytes, coalesce(files, 0) AS files
    FROM spine LEFT JOIN sums USING (run_id, tick))"""

_PROGRESS = f"""{_EV}, {_TICKS},
totals AS (SELECT run_id, CAST(sum(size) AS BIGINT) AS bytes_total FROM ev GROUP BY run_id),
prog AS (SELECT *, CAST(sum(bytes) OVER r AS BIGINT) AS bytes_copied, CAST(sum(files) OVER r AS BIGINT) AS files_copied,
    avg(bytes) OVER (PARTITION BY run_id ORDER BY idx ROWS 9 PRECEDING) AS speed
    FROM ticks JOIN totals USING (run_id) WINDOW r AS (PARTITION BY run_id ORDER BY idx))"""

_COUNTERS = """count(*) FILTER (type = 'FileStarted') AS files_scanned, count(*) FILTER (type = 'FileCompleted') AS files_copied,
  count(*) FILTER (type = 'FileFailed') AS files_failed, count(*) FILTER (type = 'FileSkipped') AS files_skipped,
  CAST(sum(CASE WHEN type IN ('FileCompleted', 'FileSkipped') THEN size ELSE 0 END) AS BIGINT) AS bytes_copied,
  count(*) FILTER (type = 'DirCreated') AS dirs_created, count(*) FILTER (type = 'HardlinkCreated') AS hardlinks_created,
  coalesce(max(total_size), 0) AS bytes_total, coalesce(max(total), 0) AS files_total,
  count(*) FILTER (type = 'VerifyOK') AS files_verified, count(*) FILTER (type = 'VerifyFailed') AS files_verify_failed,
  epoch_us(max(ts)) - epoch_us(min(ts)) AS elapsed_us"""

_STATE = """
st AS (SELECT *, lag(type) OVER w AS ptype, lag(path) OVER w AS ppath, lag(ts) OVER w AS pts
    FROM ev WHERE type IN ('FileStarted', 'FileCompleted', 'FileFailed', 'DirCreated', 'HardlinkCreated')
    WINDOW w AS (PARTITION BY run_id, worker ORDER BY ts, seq))"""

_SPARSE = """
sparse AS (SELECT concat('doc_', doc_id) AS rel_path,
    encode(text) || unhex(repeat('00', CAST(512 * (doc_id % 17) AS INTEGER))) || encode(text) AS content FROM documents),
sblocks AS (SELECT rel_path, n, b, (content[b * 512 + 1 : (b + 1) * 512]
        <> unhex(repeat('00', CAST(least(512, n - b * 512) AS INTEGER)))) AS is_data
    FROM (SELECT *, unnest(range((n + 511) // 512)) AS b FROM (SELECT *, octet_length(content) AS n FROM sparse))),
islands AS (SELECT *, b - row_number() OVER (PARTITION BY rel_path, is_data ORDER BY b) AS g FROM sblocks),
segs AS (SELECT rel_path, min(b) * 512 AS "offset", least(max(n), (max(b) + 1) * 512) - min(b) * 512 AS length, is_data
    FROM islands GROUP BY rel_path, is_data, g)"""

_AFTER = f"""
after AS (SELECT d.rel_path, d.file_type, d.size, d.mtime_ns, d.mode, d.uid FROM dst d JOIN plan p USING (rel_path)
    WHERE p.action IN ('skip', 'excluded', 'keep') AND NOT (p.reason = 'protected' AND EXISTS (
      SELECT 1 FROM plan q WHERE q.action = 'delete_dir' AND starts_with(d.rel_path, q.rel_path || '/')))
  UNION ALL SELECT s.rel_path, s.file_type, s.size, s.mtime_ns, s.mode, s.uid FROM src s JOIN plan p USING (rel_path)
    WHERE p.action IN ('mkdir', 'symlink', 'hardlink', 'copy_new', 'copy_changed'))"""

def _batches(rows):
    """The fold over `rows`, which have their number i and whether they may be batched."""
    return f"""
rows_ AS ({rows}),
fold AS (WITH RECURSIVE f AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cnt, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS nextb, CAST(NULL AS BIGINT) AS batch_id
    UNION ALL
    SELECT i, CASE WHEN taken AND NOT full_ THEN cnt + 1 ELSE 0 END, CASE WHEN taken AND NOT full_ THEN bytes + size ELSE 0 END,
      CASE WHEN taken THEN nextb + CAST(full_ AS BIGINT) ELSE nextb + CAST(cnt > 0 AS BIGINT) END, CASE WHEN taken THEN nextb END
    FROM (SELECT r.i, f.cnt, f.bytes, f.nextb, r.size, r.ok AND NOT (f.bytes + r.size > 65536 AND f.cnt > 0) AS taken,
            f.cnt + 1 >= 20 OR f.bytes + r.size >= 65536 AS full_ FROM f JOIN rows_ r ON r.i = f.i + 1)) SELECT * FROM f)"""


_BATCHES = _batches("""SELECT rel_path, file_type, size, row_number() OVER (ORDER BY rel_path) AS i,
    file_type = 'regular' AND size BETWEEN 0 AND 4096 AS ok FROM src""")

_COPIES = "action IN ('copy_new', 'copy_changed')"
_WORK = _batches(f"""SELECT *, row_number() OVER (ORDER BY rel_path) AS i, {_COPIES} AND file_type = 'regular' AND size BETWEEN 0 AND 4096 AS ok,
    CASE WHEN {_COPIES} THEN size ELSE 0 END AS cost FROM plan WHERE action IN ('mkdir', 'symlink', 'hardlink', 'copy_new', 'copy_changed')""") + """,
pieces AS (SELECT *, k * 4096 AS chunk_offset, least(4096, cost - k * 4096) AS chunk_length, s - cost + k * 4096 AS before
    FROM (SELECT *, unnest(range(greatest(1, (cost + 4095) // 4096))) AS k FROM (
      SELECT r.*, f.batch_id, sum(cost) OVER (ORDER BY r.i ROWS UNBOUNDED PRECEDING) AS s FROM rows_ r JOIN fold f USING (i))))"""


def _with(ctes, select):
    return f"WITH {ctes}\n{select}"


def _chunked(files, name, n=1024):
    return f"""{name} AS (SELECT rel_path, size, k AS chunk_idx, k * {n} AS "offset", content[k * {n} + 1 : k * {n} + {n}] AS bytes
      FROM (SELECT *, unnest(range(greatest(1, (size + {n - 1}) // {n}))) AS k FROM {files}))"""


def _tree_hash(chunks, name, fanout=4):
    return f"""{name} AS (SELECT rel_path, sha256(string_agg(h, '' ORDER BY node)) AS hash FROM (SELECT rel_path, chunk_idx // {fanout} AS node,
      sha256(string_agg(sha256(bytes), '' ORDER BY chunk_idx)) AS h FROM {chunks} GROUP BY ALL) GROUP BY rel_path)"""


_CHUNKS = f"{_FILES}, {_chunked('src_files', 'sc')}, {_chunked('dst_files', 'dc')}"


ORACLES = {
    "src_01_read_tree": """SELECT concat('source=', source) AS rel_path, 'dir' AS file_type FROM documents GROUP BY source
        UNION ALL SELECT concat('source=', source, '/lang=', lang), 'dir' FROM documents GROUP BY source, lang""",
    "src_02_subtree": _with(_TREES, "SELECT substring(rel_path, 6) AS rel_path, file_type, size FROM src WHERE starts_with(rel_path, 'src1/')"),
    "src_02_children": _with(_TREES, "SELECT rel_path, file_type FROM dst WHERE NOT contains(rel_path, '/')"),
    "src_03_load_manifest": _with(_TREES, """SELECT file_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes,
        max(mtime_ns) AS newest_ns FROM dst GROUP BY file_type"""),
    "src_04_read_content": "SELECT concat('source=', source) AS dir, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source",
    "src_01_tree_files": _with(_FILES, "SELECT rel_path, size, mtime_ns FROM src_files"),
    "src_04_read_chunks": """SELECT concat('source=', source) AS dir, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, true AS bounded, true AS complete
        FROM documents GROUP BY source""",
    "src_05_read_events": _with(_EV, """SELECT type, worker, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(error) AS errors,
        max(epoch_us(ts)) AS last_us, max(seq) AS last_seq FROM ev GROUP BY type, worker"""),
    "snk_01_write_table": _with(_TREES, "SELECT rel_path, file_type, size, mtime_ns FROM dst"),
    "snk_02_file_outcomes": _with(_EV, """SELECT run_id, p AS path, CASE type WHEN 'FileCompleted' THEN 'done' WHEN 'FileSkipped' THEN 'skipped'
        ELSE 'failed' END AS outcome, size, error FROM (SELECT *, regexp_extract(path, '^/dst/[0-9]+') AS p FROM ev
        WHERE type IN ('FileCompleted', 'FileSkipped', 'FileFailed'))
        QUALIFY row_number() OVER (PARTITION BY run_id, p ORDER BY ts DESC, seq DESC) = 1"""),
    "fil_01_filter_chain": _with(_TREES, f"SELECT rel_path, file_type, size, {_keep()} AS kept FROM src"),
    "fil_02_globs": _with(_TREES, """SELECT rel_path, regexp_matches(rel_path, '(^|/)[^/]*\\.log$') AS star,
        regexp_matches(rel_path, '^(.*/)?[^/]*\\.md$') AS any_depth, regexp_matches(rel_path, '^src3/[^/]*/doc_[^/]\\.txt$') AS anchored,
        regexp_matches(rel_path, '^src2/en/[^/]*\\.bin$') AS inner, file_type = 'dir' AND regexp_matches(rel_path, '(^|/)en$') AS dir_only,
        regexp_matches(rel_path, '(^|/)doc_[^/][^/]\\.[^/]*$') AS one, regexp_matches(rel_path, '(^|/)doc_[1-3][^/]*$') AS cls,
        regexp_matches(rel_path, '(^|/)doc_[^1-8][^/]*$') AS negated, regexp_matches(rel_path, '^src[02]/.*$') AS rest,
        regexp_matches(rel_path, '(^|/)doc_\\[1[^/]*$') AS open FROM src"""),
    "fil_03_size_bounds": _with(_TREES, "SELECT rel_path, size FROM src WHERE file_type = 'dir' OR size BETWEEN 200 AND 2000"),
    "fil_04_prune": _with(_TREES, f"SELECT rel_path, file_type FROM src WHERE {_keep()} AND NOT {_pruned()}"),
    "fil_05_known_types": _with(_TREES, "SELECT rel_path, file_type FROM src WHERE file_type = 'dir' OR NOT rel_path LIKE '%.log'"),
    "fil_06_orphan_temps": _with(_TREES, """SELECT concat(regexp_replace(rel_path, '/[^/]*$', ''), '/.', regexp_extract(rel_path, '[^/]*$'), '.',
        substring(md5(rel_path), 1, 8), '.part') AS rel_path, size FROM src WHERE file_type = 'regular' AND rel_path LIKE '%.log'"""),
    "prj_01_map_paths": _with(_TREES, """SELECT rel_path, concat('/backup/', rel_path) AS contents, concat('/backup/tree/', rel_path) AS below,
        CASE WHEN file_type = 'dir' THEN '/backup' ELSE concat('/backup/', regexp_extract(rel_path, '[^/]*$')) END AS as_argument FROM src"""),
    "prj_02_strip_root": _with(_EV, """SELECT seq, substring(path, 6) AS below_dst,
        CASE WHEN starts_with(path, '/dst/1/') THEN substring(path, 8) ELSE path END AS below_1, path AS as_is FROM ev"""),
    "prj_03_rebase": _with(_EV, """SELECT seq, regexp_extract(path, '^/dst/([0-9]+)', 1) AS prefix, '' AS guarded, substring(path, 6) AS served,
        regexp_extract(path, '[^/]*$') AS client FROM ev"""),
    "prj_04_copy_strategy": _with(f"{_TREES}, {_plan(delete=False)}", """SELECT rel_path, action, size, CASE WHEN action IN ('copy_new', 'copy_changed')
        THEN CASE WHEN size >= 2048 AND coalesce(basis_size, 0) > 0 THEN 'delta_push' ELSE 'stream' END END AS strategy FROM plan"""),
    "prj_05_chunks": _with(_TREES, """SELECT rel_path, k AS chunk_idx, k * 4096 AS "offset", least(4096, size - k * 4096) AS length
        FROM (SELECT *, unnest(range((size + 4095) // 4096)) AS k FROM src WHERE size > 4096)"""),
    "joi_01_skipped": _with(_TREES, """SELECT s.rel_path, s.size FROM src s JOIN dst d ON s.rel_path = d.rel_path AND s.size = d.size
        AND s.mtime_ns = d.mtime_ns WHERE s.file_type = 'regular'"""),
    "joi_02_sync_plan": _with(f"{_TREES}, {_plan()}", "SELECT rel_path, action, file_type, size, reason, link_target FROM plan"),
    "joi_02_plan_summary": _with(f"{_TREES}, {_plan()}", "SELECT action, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM plan GROUP BY action"),
    "joi_02_plan_capabilities": _with(f"{_TREES}, {_plan(hardlinks=False)}", "SELECT rel_path, action, reason, link_target FROM plan"),
    "joi_02_work_plan": _with(f"{_TREES}, {_plan()}, {_WORK}", f"""SELECT rel_path, action, file_type, size, reason, basis_size, link_target,
        CASE WHEN {_COPIES} THEN CASE WHEN size >= 2048 AND coalesce(basis_size, 0) > 0 THEN 'delta_push' ELSE 'stream' END END AS strategy, batch_id,
        k AS chunk_idx, chunk_offset, CAST(chunk_length AS BIGINT) AS chunk_length,
        greatest(0.0::DOUBLE, (CAST(before AS DOUBLE) - 1000000.0::DOUBLE) / 1000000.0::DOUBLE) AS est_start_s,
        greatest(0.0::DOUBLE, (CAST(before + chunk_length AS DOUBLE) - 1000000.0::DOUBLE) / 1000000.0::DOUBLE) AS est_end_s FROM pieces"""),
    "joi_03_extraneous": _with(_TREES, f"SELECT rel_path, file_type FROM dst WHERE {_keep()} AND rel_path NOT IN (SELECT rel_path FROM src)"),
    "joi_04_verify": _with(f"{_FILES}, {_VERIFY}", "SELECT * FROM v"),
    "joi_05_metadata_drift": _with(_TREES, """SELECT rel_path, drift FROM (SELECT s.rel_path, concat_ws(',', CASE WHEN s.mode <> d.mode THEN 'mode' END,
        CASE WHEN s.mtime_ns <> d.mtime_ns THEN 'mtime' END, CASE WHEN s.uid <> d.uid THEN 'uid' END, CASE WHEN s.gid <> d.gid THEN 'gid' END) AS drift
        FROM src s JOIN dst d USING (rel_path)) WHERE drift <> ''"""),
    "joi_06_block_matches": _with(f"{_FILES}, {_blocks('src_files', 512, 'sb')}, {_blocks('dst_files', 512, 'db')}",
        """SELECT rel_path, sb.block_idx, sb."offset", CAST(octet_length(bytes) AS INTEGER) AS length, basis_idx
        FROM sb JOIN (SELECT rel_path, bytes, min(block_idx) AS basis_idx FROM db GROUP BY ALL) USING (rel_path, bytes)"""),
    "joi_06_changed_blocks": _with(f"{_FILES}, {_blocks('src_files', 512, 'sb')}, {_blocks('dst_files', 512, 'db')}",
        """SELECT rel_path, block_idx, "offset", CAST(octet_length(bytes) AS INTEGER) AS length FROM sb
        WHERE NOT EXISTS (SELECT 1 FROM db WHERE db.rel_path = sb.rel_path AND db.bytes = sb.bytes)"""),
    "joi_07_hardlink_targets": _with(_TREES, f"SELECT * FROM {_links('true')} WHERE rel_path <> first_path"),
    "joi_08_apply_delta": _with(_FILES, "SELECT rel_path, sha256(content) AS hash FROM src_files WHERE size > 0"),
    "agg_01_prescan": _with(_TREES, f"""SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM src
        WHERE file_type = 'regular' AND {_keep()} AND NOT {_pruned()}"""),
    "agg_02_snapshot": _with(_EV, f"SELECT {_COUNTERS} FROM ev"),
    "agg_03_hardlink_groups": _with(_TREES, """SELECT dev, ino, min(rel_path) AS first_path, count(*) AS n, (count(*) - 1) * max(size) AS bytes_saved
        FROM src WHERE file_type = 'regular' AND nlink > 1 GROUP BY dev, ino HAVING count(*) > 1"""),
    "agg_04_signatures": _with(f"{_FILES}, {_blocks('src_files', _AUTO, 'sb')}",
        """SELECT rel_path, block_idx, "offset", CAST(length AS INTEGER) AS length, block_size, sha256(bytes) AS strong FROM sb"""),
    "agg_05_tree_hashes": _with(f"{_FILES}, {_chunked('src_files', 'sc')}, {_tree_hash('sc', 'sh')}", "SELECT * FROM sh"),
    "joi_08_rebuild_chunks": _with(f"{_FILES}, {_chunked('src_files', 'sc')}",
        """SELECT rel_path, size, chunk_idx, "offset", sha256(bytes) AS hash FROM sc WHERE size > 0"""),
    "joi_04_differing_chunks": _with(_CHUNKS, """SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, coalesce(a.chunk_idx, b.chunk_idx) AS chunk_idx,
        coalesce(a."offset", b."offset") AS "offset" FROM sc a FULL JOIN dc b ON a.rel_path = b.rel_path AND a.chunk_idx = b.chunk_idx
        WHERE a.bytes IS DISTINCT FROM b.bytes AND coalesce(a.rel_path, b.rel_path) IN (SELECT rel_path FROM src_files JOIN dst_files USING (rel_path))"""),
    "joi_04_verify_chunks": _with(f"{_CHUNKS}, {_tree_hash('sc', 'sh')}, {_tree_hash('dc', 'dh')}", f"""SELECT rel_path, sh.hash AS src_hash, dh.hash AS dst_hash,
        CASE WHEN sh.hash = dh.hash THEN 'ok' ELSE 'mismatch' END AS status FROM dst_files d JOIN sh USING (rel_path) JOIN dh USING (rel_path) WHERE {_keep('d.')}"""),
    "agg_05_file_hashes": _with(_FILES, "SELECT rel_path, sha256(content) AS hash FROM src_files"),
    "agg_06_delta_stats": _with(f"{_FILES}, {_MATCH}", """SELECT rel_path, count(*) FILTER (block_idx >= 0) AS matched_blocks,
        CAST(coalesce(sum(len) FILTER (block_idx < 0), 0) AS BIGINT) AS literal_bytes, CAST(sum(len) AS BIGINT) AS bytes FROM ops GROUP BY rel_path"""),
    "agg_07_dst_overlaps": """SELECT dst_base, count(*) AS sources FROM (SELECT DISTINCT source, lang, doc_id % 2 AS odd,
        CASE WHEN doc_id % 2 = 0 THEN '/backup' ELSE concat('/backup/', lang) END AS dst_base FROM documents) GROUP BY dst_base HAVING count(*) > 1""",
    "agg_07_guarded_extraneous": _with(_TREES, f"""SELECT rel_path, file_type FROM dst WHERE {_keep()}
        AND rel_path NOT IN (SELECT rel_path FROM src WHERE NOT suffix(rel_path, '.bin')) AND string_split(rel_path, '/')[1] NOT IN (SELECT source FROM documents
          WHERE source <> 'src0' OR lang = 'en' GROUP BY source HAVING count(DISTINCT lang) > 1)"""),
    "agg_08_verify_summary": _with(f"{_FILES}, {_VERIFY}", "SELECT status, count(*) AS files FROM v GROUP BY status"),
    "agg_09_summary": _with(f"{_EV}, c AS (SELECT run_id, {_COUNTERS} FROM ev GROUP BY run_id)", """SELECT run_id, files_copied AS files,
        bytes_copied AS bytes, bytes_copied / (elapsed_us / 1e6) AS avg_bytes_per_s, elapsed_us, files_verified AS verified,
        files_failed + files_verify_failed AS errors, files_failed = 0 AS clean FROM c"""),
    "agg_10_batch_outcomes": _with(f"""{_EV}, f AS (SELECT seq // 50 AS batch_id, size, CASE WHEN type = 'FileStarted' THEN NULL
          ELSE type <> 'FileFailed' END AS answered FROM ev),
        lost AS (SELECT seq // 50 AS batch_id FROM ev WHERE seq % 50 = 0 AND type = 'VerifyFailed'),
        r AS (SELECT *, CASE WHEN batch_id IN (SELECT batch_id FROM lost) THEN false ELSE answered END AS ok FROM f)""",
        """SELECT batch_id, count(*) FILTER (ok) AS copied, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS unanswered,
        CAST(coalesce(sum(size) FILTER (ok), 0) AS BIGINT) AS bytes FROM r GROUP BY batch_id"""),
    "agg_11_error_summary": _with(f"""{_EV}, e AS (SELECT run_id, arg_min(concat('io error ', path), (ts, seq)) AS first_error, count(*) - 1 AS more
        FROM ev WHERE type = 'FileFailed' GROUP BY run_id)""",
        "SELECT *, CASE WHEN more > 0 THEN concat(first_error, ' (and ', more, ' more errors)') ELSE first_error END AS message FROM e"),
    "agg_12_run_outcome": _with(f"{_EV}, c AS (SELECT run_id, {_COUNTERS} FROM ev GROUP BY run_id)", """SELECT run_id,
        CAST(CASE WHEN files_failed + files_verify_failed = 0 THEN 0 WHEN files_copied > 0 THEN 1 ELSE 2 END AS INTEGER) AS code FROM c"""),
    "win_01_pack_batches": _with(f"{_TREES}, {_BATCHES}", "SELECT rel_path, file_type, size, batch_id FROM fold JOIN rows_ USING (i)"),
    "win_01_approximate_batches": _with(_TREES, """SELECT rel_path, size, CAST(coalesce(sum(size) OVER (ORDER BY rel_path ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) // 65536 AS BIGINT) AS batch_id FROM src WHERE file_type = 'regular' AND size <= 4096"""),
    "win_02_ticks": _with(f"{_EV}, {_TICKS}", "SELECT * FROM ticks"),
    "win_03_rolling": _with(f"{_EV}, {_TICKS}", """SELECT run_id, tick, avg(bytes) OVER w AS avg_bytes, avg(files) OVER w AS avg_files FROM ticks
        WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS 9 PRECEDING)"""),
    "win_04_last_samples": _with(f"{_EV}, {_TICKS}", """SELECT run_id, tick, array_to_string(list(bytes) OVER (PARTITION BY run_id ORDER BY idx
        ROWS 7 PRECEDING), ',') AS samples FROM ticks"""),
    "win_05_eta": _with(_PROGRESS, """SELECT run_id, tick, CASE WHEN speed > 0 AND bytes_total > bytes_copied
        THEN CAST(trunc((bytes_total - bytes_copied) / (speed / 3600.0::DOUBLE)) AS BIGINT) ELSE 0 END AS eta_s FROM prog"""),
    "win_06_progress": _with(_PROGRESS, """SELECT run_id, tick, bytes_copied, files_copied, bytes_total, bytes_copied / bytes_total AS fraction FROM prog"""),
    "win_07_rate_mode": _with(f"""{_EV}, {_TICKS}, f AS (SELECT run_id, tick, idx, avg(files) OVER (PARTITION BY run_id ORDER BY idx
        ROWS 1 PRECEDING) AS fps FROM ticks)""", """SELECT run_id, tick, coalesce(last_value(CASE WHEN fps > 1.0 THEN true WHEN fps < 0.5 THEN false END
        IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY idx), false) AS high FROM f"""),
    "win_08_busy_workers": _with(f"{_EV}, {_STATE}", """SELECT run_id, seq, worker, type, CAST(sum(CAST(type = 'FileStarted' AS INTEGER)
        - CAST(coalesce(ptype, '') = 'FileStarted' AS INTEGER)) OVER (PARTITION BY run_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS busy FROM st"""),
    "win_09_in_flight": _with(_EV, """SELECT run_id, worker, path, size, (SELECT arg_max(p.size, (p.ts, p.seq)) FROM ev p WHERE p.run_id = s.run_id AND p.worker = s.worker
          AND p.type = 'FileProgress' AND p.ts <= TIMESTAMP '2024-01-20 12:00:00' AND (p.ts > s.ts OR p.ts = s.ts AND p.seq > s.seq)) AS progress,
        epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts) AS so_far_us FROM (SELECT * FROM ev WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'
          AND type IN ('FileStarted', 'FileCompleted', 'FileFailed', 'DirCreated', 'HardlinkCreated') QUALIFY row_number() OVER (PARTITION BY run_id, worker ORDER BY ts DESC, seq DESC) = 1)
        s WHERE type = 'FileStarted'"""),
    "win_10_segments": _with(_SPARSE, "SELECT * FROM segs"),
    "win_10_data_bytes": _with(_SPARSE, """SELECT rel_path, CAST(coalesce(sum(length) FILTER (is_data), 0) AS BIGINT) AS data_bytes,
        CAST(coalesce(sum(length) FILTER (NOT is_data), 0) AS BIGINT) AS hole_bytes FROM segs GROUP BY rel_path"""),
    "win_11_schedule": _with(f"""{_FILES}, t AS (SELECT rel_path, size, sum(size) OVER (ORDER BY rel_path ROWS UNBOUNDED PRECEDING) AS s FROM src_files)""",
        """SELECT rel_path, greatest(0.0::DOUBLE, (CAST(s - size AS DOUBLE) - 1000000.0::DOUBLE) / 1000000.0::DOUBLE) AS est_start_s,
        greatest(0.0::DOUBLE, (CAST(s AS DOUBLE) - 1000000.0::DOUBLE) / 1000000.0::DOUBLE) AS est_end_s FROM t"""),
    "win_11_schedule_arrivals": _with(f"""{_FILES}, t AS (SELECT *, sum(size) OVER (ORDER BY mtime_ns, rel_path ROWS UNBOUNDED PRECEDING) AS s,
          CAST(mtime_ns - 1704067200000000000 AS DOUBLE) / 1e9::DOUBLE / 512 AS arr FROM src_files),
        u AS (SELECT *, max(arr - CAST(s - size AS DOUBLE) / 1e6::DOUBLE) OVER (ORDER BY mtime_ns, rel_path ROWS UNBOUNDED PRECEDING) AS idle FROM t)""",
        """SELECT rel_path, arr AS est_start_s, greatest(arr, (CAST(s AS DOUBLE) - 1000000.0::DOUBLE) / 1e6::DOUBLE + idle) AS est_end_s FROM u"""),
    "win_12_file_durations": _with(f"{_EV}, {_STATE}", """SELECT run_id, worker, seq, path, ppath AS started_path, size, epoch_us(ts) - epoch_us(pts) AS duration_us,
        CASE WHEN ts > pts THEN size / ((epoch_us(ts) - epoch_us(pts)) / 1e6::DOUBLE) END AS bytes_per_s FROM st
        WHERE type IN ('FileCompleted', 'FileFailed') AND ptype = 'FileStarted'"""),
    "srt_01_delete_order": _with(_TREES, f"""SELECT rel_path, file_type, row_number() OVER (ORDER BY file_type = 'dir',
        CASE WHEN file_type = 'dir' THEN rel_path END DESC, rel_path) - 1 AS position FROM dst
        WHERE {_keep()} AND rel_path NOT IN (SELECT rel_path FROM src)"""),
    "srt_01_delete_sorted": _with(_TREES, f"""SELECT rel_path, size FROM dst WHERE {_keep()} AND rel_path NOT IN (SELECT rel_path FROM src)"""),
    "srt_02_recent_errors": _with(_EV, """SELECT run_id, epoch_us(ts) AS ts, seq, path, CASE WHEN type = 'VerifyFailed' THEN 'CHECKSUM MISMATCH' ELSE error END AS error
        FROM ev WHERE type IN ('FileFailed', 'VerifyFailed') ORDER BY ev.ts DESC, seq DESC LIMIT 5"""),
    "srt_03_lowest_block": _with(f"""twice AS (SELECT concat('doc_', doc_id) AS rel_path,
          encode(repeat(concat(text, repeat('.', (512 - strlen(text) % 512) % 512)), 3)) AS content FROM documents),
        {_blocks('twice', 512, 'tb')}""", """SELECT rel_path, block_idx, "offset", CAST(octet_length(bytes) AS INTEGER) AS length,
        min(block_idx) OVER (PARTITION BY rel_path, bytes) AS basis_idx FROM tb"""),
    "set_01_merge_sources": _with(_TREES, f"""SELECT CAST(o AS INTEGER) AS source_ord, rel_path, b AS dst_base, concat(b, '/', rel_path) AS dst_path, size
          FROM src, (VALUES (0, '/backup'), (1, '/backup/b')) t(o, b) WHERE {_keep()} AND NOT {_pruned()}
        UNION ALL SELECT 2, rel_path, '/backup/one.txt', '/backup/one.txt', size FROM dst WHERE file_type = 'regular'"""),
    "set_01_plan_sources": _with(f"{_TREES}, {_plan()}", f"""SELECT CAST(0 AS INTEGER) AS source_ord, concat('/backup/', rel_path) AS dst_path, action,
        link_target FROM plan UNION ALL SELECT 1, concat('/backup/tree/', s.rel_path), CASE WHEN NOT {_keep('s.')} OR {_pruned('s.')} THEN 'excluded'
        WHEN file_type = 'dir' THEN 'mkdir' WHEN f.first_path IS NOT NULL THEN 'hardlink' ELSE 'copy_new' END, f.first_path
        FROM src s LEFT JOIN (SELECT * FROM {_links(f"{_keep('s.')} AND NOT {_pruned('s.')}")} WHERE rel_path <> first_path) f USING (rel_path)"""),
    "set_02_apply_plan": _with(f"{_TREES}, {_plan()}, {_AFTER}", "SELECT * FROM after"),
    "set_02_replan": _with(f"{_TREES}, {_plan()}, {_AFTER}", """SELECT action, count(*) AS n FROM (SELECT CASE WHEN reason IN ('protected', 'rule',
        'under excluded directory') THEN 'excluded' WHEN file_type = 'dir' THEN 'mkdir' ELSE 'skip' END AS action FROM plan p
        WHERE p.action NOT IN ('delete_file', 'delete_dir') AND NOT (p.reason = 'protected' AND rel_path NOT IN (SELECT rel_path FROM after))) GROUP BY action"""),
    "stm_01_stream_events": _with(_EV, "SELECT epoch_us(ts) AS ts, type, path, size, worker, error FROM ev"),
    "stm_02_stream_snapshot": _with(_EV, f"SELECT run_id, {_COUNTERS} FROM ev GROUP BY run_id"),
    "stm_03_stream_ticks": _with(f"{_EV}, {_TICKS}", "SELECT run_id, tick * 3600000000 AS start, bytes, files FROM sums"),
    "stm_04_stream_rolling": _with(f"""{_EV}, {_TICKS}, w AS (SELECT run_id, (tick + k + 1) AS e, sum(bytes) AS bytes, sum(files) AS files
          FROM (SELECT *, unnest(range(10)) AS k FROM sums) GROUP BY ALL)""",
        """SELECT run_id, e * 3600000000 AS "end", CAST(bytes AS BIGINT) AS bytes, CAST(files AS BIGINT) AS files, CAST(bytes AS DOUBLE) / 36000.0::DOUBLE AS bytes_per_s,
        CAST(files AS DOUBLE) / 36000.0::DOUBLE AS files_per_s FROM w"""),
    "stm_05_worker_state": _with(_EV, """SELECT run_id, worker, CASE WHEN type = 'FileStarted' THEN 'in_flight' ELSE 'idle' END AS kind, path, size, epoch_us(ts) AS at_us
        FROM ev WHERE type IN ('FileStarted', 'FileCompleted', 'FileFailed', 'DirCreated', 'HardlinkCreated') QUALIFY row_number() OVER (PARTITION BY run_id, worker ORDER BY ts DESC, seq DESC) = 1"""),
    "stm_05_finished": _with(f"{_EV}, {_STATE}", """SELECT run_id, worker, path, size, epoch_us(ts) AS at_us, epoch_us(ts) - epoch_us(pts) AS duration_us
        FROM st WHERE type IN ('FileCompleted', 'FileFailed') AND ptype = 'FileStarted'"""),
    "stm_06_session_batches": _with(f"""{_EV}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1200000000 THEN 0 ELSE 1 END AS new_
          FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY ts)), h AS (SELECT *, sum(new_) OVER (PARTITION BY run_id ORDER BY ts) AS b FROM g)""",
        """SELECT run_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1200000000 AS "end", count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
        FROM h GROUP BY run_id, b"""),
    # One task per step and lane: open batch `no` with `n` files and `b` bytes, and where the task went.
    "stm_06_stream_batches": f"""WITH RECURSIVE {_EV}, t AS (SELECT worker AS lane, size, epoch_us(ts) AS us,
          coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000, false) AS pause, row_number() OVER w AS k
          FROM ev WINDOW w AS (PARTITION BY worker ORDER BY ts, path)),
        s AS (SELECT lane, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS went,
              CAST(0 AS BIGINT) AS size FROM (SELECT DISTINCT lane FROM t)
          UNION ALL SELECT lane, k, CASE WHEN joins AND (n + 1 >= 12 OR b + size >= 60000) THEN no + 1 WHEN joins THEN no WHEN n > 0 THEN no + 1 ELSE no END,
              CASE WHEN joins AND n + 1 < 12 AND b + size < 60000 THEN n + 1 ELSE 0 END, CASE WHEN joins AND n + 1 < 12 AND b + size < 60000 THEN b + size ELSE 0 END,
              CASE WHEN joins THEN no END, size
          FROM (SELECT *, size BETWEEN 0 AND 15000 AND (n = 0 OR b + size <= 60000) AS joins
            FROM (SELECT s.lane, t.k, t.size, CASE WHEN pause AND n > 0 THEN no + 1 ELSE no END AS no, CASE WHEN pause THEN 0 ELSE n END AS n,
              CASE WHEN pause THEN 0 ELSE b END AS b FROM s JOIN t ON t.lane = s.lane AND t.k = s.k + 1)))
        SELECT CAST(lane AS INTEGER) AS lane, went AS batch_no, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM s WHERE k > 0 GROUP BY lane, went""",
    "stm_07_incremental_plan": _with(f"{_TREES}, {_plan(False, False)}", "SELECT rel_path, action, reason FROM plan WHERE rel_path IN (SELECT rel_path FROM src_files)"),
    "stm_08_live_failures": _with(_EV, """SELECT run_id, epoch_us(ts) AS ts, seq, type, path, CASE WHEN type = 'VerifyFailed' THEN 'CHECKSUM MISMATCH' ELSE error END AS error
        FROM ev WHERE type IN ('FileFailed', 'VerifyFailed')"""),
    "stm_09_fan_out": _with(f"""{_EV}, l AS (SELECT *, CASE WHEN type IN ('FileFailed', 'VerifyFailed') THEN 'ERROR' WHEN type = 'FileCompleted' THEN 'INFO'
          ELSE 'DEBUG' END AS level FROM ev)""", """SELECT sink, level, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes
        FROM l JOIN (VALUES ('all', 0), ('info', 1), ('errors', 2)) t(sink, lowest)
        ON CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 ELSE 2 END >= lowest GROUP BY sink, level"""),
    "udf_01_match_blocks": _with(f"{_FILES}, {_MATCH}", """SELECT rel_path, CAST(seq AS INTEGER) AS seq, CAST(block_idx AS INTEGER) AS block_idx,
        CAST(CASE WHEN block_idx < 0 THEN 0 ELSE block_idx * w END AS BIGINT) AS "offset", CAST(len AS INTEGER) AS length,
        CASE WHEN block_idx < 0 THEN sha256(content[pos + 1 : pos + len]) END AS literal_sha FROM ops JOIN src_files USING (rel_path)"""),
    "udf_02_delta_sync": _with(f"{_FILES}, {_MATCH}", """SELECT rel_path,
        CASE WHEN any_value(s.size) < 2048 THEN 0 ELSE count(*) FILTER (block_idx >= 0) END AS matched_blocks,
        CASE WHEN any_value(s.size) < 2048 THEN any_value(s.size) ELSE CAST(coalesce(sum(len) FILTER (block_idx < 0), 0) AS BIGINT) END AS literal_bytes,
        any_value(s.size) AS bytes, true AS identical FROM ops JOIN src_files s USING (rel_path) GROUP BY rel_path"""),
    "snk_02_report_header": _with(_EV, """SELECT run_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS completed,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s, count(*) FILTER (type = 'FileCompleted') AS files,
        CAST(coalesce(sum(size) FILTER (type IN ('FileCompleted', 'FileSkipped')), 0) AS BIGINT) AS bytes,
        round(coalesce(sum(size) FILTER (type IN ('FileCompleted', 'FileSkipped')), 0) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS bytes_per_s,
        count(*) FILTER (type IN ('FileFailed', 'VerifyFailed')) AS errors FROM ev GROUP BY run_id"""),
    "agg_11_verify_errors": _with(_EV, """SELECT run_id, concat(count(*), ' files failed verification') AS message
        FROM ev WHERE type = 'VerifyFailed' GROUP BY run_id"""),
}
ORACLES["stm_07_folded_plan"] = ORACLES["stm_07_incremental_plan"]
# The same result whatever the chunks.
ORACLES["udf_01_match_chunks"] = ORACLES["udf_01_match_chunked"] = ORACLES["agg_06_delta_stats"]
ORACLES["agg_04_chunked_signatures"] = ORACLES["agg_04_signatures"]
