"""Small numpy kernels for block matching, run inside tasks on one chunk of one file.

The window hash is a polynomial sum modulo 2**64 over a fixed byte table: prefix sums give the
hash of every window of a chunk in a few vector operations, whatever the window length.
"""

import hashlib

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# Powers that a task keeps for all its chunks (1 MB a table); longer chunks make their own.
KEPT_POWERS = 1 << 17


class _Once(dict):
    """Tables made once by a task. Kernels travel without them."""

    def __reduce__(self):
        return _Once, ()


_KEPT = _Once()


def _tables(which: int):
    if which not in _KEPT:
        _KEPT[which] = np.random.default_rng(which + 1).integers(0, 2**64, 256, dtype=np.uint64)
    return _KEPT[which]


def _made_powers(which: int, inverse: bool, n: int):
    base = _BASES[which]
    base = pow(base, -1, 2**64) if inverse else base
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _powers(which: int, inverse: bool, n: int):
    if n > KEPT_POWERS:
        return _made_powers(which, inverse, n)
    if (which, inverse) not in _KEPT:
        _KEPT[which, inverse] = _made_powers(which, inverse, KEPT_POWERS)
    return _KEPT[which, inverse][:n]


def window_hashes(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every window of `width` bytes."""
    n = len(data)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    up, down = (_powers(which, inverse, n) for inverse in (False, True))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_tables(which)[data] * up, out=prefix[1:])
    return (prefix[width:] - prefix[:n - width + 1]) * down[:n - width + 1]


def block_hashes(blocks, slab=8 << 20) -> np.ndarray:
    """Hash of each block, equal to the window hash of the same bytes. Blocks of one length are
    worked on together, at most `slab` bytes at a time."""
    lengths = np.fromiter((len(b) for b in blocks), dtype=np.int64, count=len(blocks))
    out, table = np.zeros(len(blocks), dtype=np.uint64), _tables(0)
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, slab // n)
        up = _powers(0, False, n)
        for lo in range(0, len(at), step):
            part = at[lo:lo + step]
            data = np.frombuffer(b"".join(blocks[k] for k in part), dtype=np.uint8).reshape(len(part), n)
            out[part] = (table[data] * up).sum(axis=1, dtype=np.uint64)
    return out.astype(np.int64)


class Basis:
    """The whole blocks of a basis file, to be looked up by window hash. Serves all chunks of a file."""

    def __init__(self, rolls: np.ndarray, strongs):
        self.strongs = strongs
        self.keys, by_key = np.unique(rolls.astype(np.uint64), return_inverse=True)
        # The blocks of a key in rising order.
        self.blocks = np.argsort(by_key, kind="stable").tolist()
        self.first = np.searchsorted(by_key[self.blocks], np.arange(len(self.keys) + 1)).tolist()
        self.low = np.zeros(1 << 16, dtype=bool)
        self.low[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def lowest(self, key: int, data: bytes) -> int:
        """The lowest block of a key with these bytes, or -1."""
        digest = hashlib.sha256(data).digest()
        return next((i for i in self.blocks[self.first[key]:self.first[key + 1]] if self.strongs[i] == digest), -1)


def full_matches(buf: bytes, width: int, basis: Basis, limit: int):
    """Positions below `limit` whose window equals a basis block, and the lowest such block.

    The window hash only nominates; SHA-256 decides, once per distinct hash for all windows that
    also agree in a second hash, so repetitive data costs one digest and not one per position."""
    none = np.empty(0, dtype=np.int64)
    data = np.frombuffer(buf, dtype=np.uint8)
    keys = basis.keys
    hashes = window_hashes(data, width)[:limit]
    if not len(hashes) or not len(keys):
        return none, none
    pos = np.flatnonzero(basis.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    key = np.minimum(np.searchsorted(keys, hashes[pos]), len(keys) - 1)
    same = keys[key] == hashes[pos]
    pos, key = pos[same], key[same]
    if not len(pos):
        return none, none
    # A key that is found is verified at its first position.
    found, first, which = np.unique(key, return_index=True, return_inverse=True)
    hit = np.array([basis.lowest(k, buf[p:p + width]) for k, p in zip(found.tolist(), pos[first].tolist())])[which]
    if len(pos) > len(found):
        second = window_hashes(data, width, 1)[pos]
        for n in np.flatnonzero(second != second[first[which]]).tolist():      # same hash, other bytes
            hit[n] = basis.lowest(int(key[n]), buf[pos[n]:pos[n] + width])
    return pos[hit >= 0], hit[hit >= 0]


def chunk_matches(buf, length, width, basis, tail_len, tail_strong, tail_idx, tail_at):
    """All match positions of a chunk of `length` bytes (`buf` reads on past it): whole basis
    blocks anywhere, and the short last basis block only where the source file ends."""
    pos, idx = full_matches(buf, width, basis, length)
    if tail_len and 0 <= tail_at < length and hashlib.sha256(buf[tail_at:tail_at + tail_len]).digest() == tail_strong:
        pos, idx = np.append(pos, tail_at), np.append(idx, tail_idx)
    return pos, idx


def walk(pos, idx, width, tail_idx, tail_len, entry, length):
    """Greedy left-to-right choice from `entry`: take the next match, jump behind it."""
    at, out = entry, []
    while at < length:
        k = int(np.searchsorted(pos, at))
        if k == len(pos):
            break
        p, b = int(pos[k]), int(idx[k])
        n = tail_len if b == tail_idx else width
        out.append((p, b, n))
        at = p + n
    return out


def exits(pos, width, length, tail_at, tail_len):
    """Where a greedy walk leaves a chunk that is not the file's last, per entry offset below
    `width`: runs (first entry, exit), exits counted from the chunk's end.

    An entry leads to the next match. A match leads out of the chunk or to the first match behind it;
    these steps are followed by all matches at once, twice as far each time."""
    pos = np.asarray(pos, dtype=np.int64)
    end = pos + width
    if tail_len and len(pos) and pos[-1] == tail_at:
        end[-1] = tail_at + tail_len
    # Behind the last match, the walk enters the next chunk at its start.
    out = np.append(end - length, 0)
    to = np.append(np.where(end < length, np.searchsorted(pos, end), np.arange(len(pos))), len(pos))
    while True:
        further = to[to]
        if (further == to).all():
            break
        to = further
    starts = np.append(0, pos + 1)
    starts = starts[:np.searchsorted(starts, width)]
    table = out[to[:len(starts)]]
    new = np.append(True, table[1:] != table[:-1])
    return starts[new].astype(np.int32), table[new].astype(np.int32)
