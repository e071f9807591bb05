"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from driftline.functions.globs import filter_chain
from driftline.operators import delta, filtering, progress
from driftline.plans import sync
from driftline.plans.verify import verify_trees
from driftline.schemas import TRANSFER_EVENTS
from driftline.sources.tables import load_manifest, write_bucketed, write_table
from registry import samples
from registry.queries import QUERIES
from tests_util import SF


def explain(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("m") / "src")
    write_table(samples.src(spark, SF), out)
    return load_manifest(spark, out)


BATCH = [n for n in QUERIES if not n.startswith("stm_")]


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins(spark, name):
    text = explain(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text           # no row-at-a-time Python


def test_filters_and_columns_reach_the_scan(spark, stored):
    text = explain(filtering.subtree(stored, "src1").select("rel_path"))
    assert "StringStartsWith(rel_path,src1/)" in text
    text = explain(filtering.prescan(stored, filter_chain(["- *.tmp"], 64)))
    assert "ReadSchema: struct<rel_path:string,file_type:string,size:bigint>" in text
    assert "EqualTo(file_type,regular)" in text
    assert text.count("Exchange") <= 4             # one shuffle of one row per task


def test_plan_shuffles_each_side_once(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sync.sync_plan(stored, stored, filter_chain(["- *.tmp"]), sync.SyncOptions(delete=True, hardlinks=False))
        text = explain(plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") == 2 and tree.count("FullOuter") == 1 and "Window" not in tree
    assert "xattrs" not in text.split("ReadSchema")[1].split("\n")[0]


def test_plan_with_hardlinks_reads_each_side_once(spark, stored, tmp_path):
    other = str(tmp_path / "dst")
    write_table(samples.dst(spark, SF), other)
    d = load_manifest(spark, other)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree = explain(sync.compare(stored, d)).split("\n\n")[0]
        assert tree.count("Scan parquet") == 2 and tree.count("Exchange") == 2 and tree.count("FullOuter") == 1
        # What is settled behind the join reads the compared rows, never a manifest again.
        text = explain(sync.sync_plan(stored, d))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    places = [line for line in text.split("\n") if line.startswith("Location:")]
    assert places and all("/cut-" in line for line in places)


def test_bucketed_manifests_join_without_a_shuffle(spark, stored, tmp_path):
    a, b = (write_bucketed(stored, f"bucketed_{n}", str(tmp_path / n), 4) for n in "ab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sync.sync_plan(a, b, opts=sync.SyncOptions(delete=True, hardlinks=False))
        assert "Exchange" not in explain(plan).split("\n\n")[0]
        assert plan.filter("action not in ('skip', 'mkdir')").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_a")
        spark.sql("DROP TABLE bucketed_b")


def test_verify_shuffles_digests_not_bytes(spark, stored):
    c = samples.src_content(spark, SF)
    text = explain(verify_trees(stored, stored, c, c))
    for part in text.split("\n\n"):
        if part.lstrip().startswith("(") and ") Exchange" in part:
            assert "content" not in part and "text" not in part


def test_ticks_are_aggregated_before_the_shuffle(spark):
    ev = spark.createDataFrame([], TRANSFER_EVENTS)
    text = explain(progress.ticks(ev.repartition(2).filter(F.col("run_id").isNotNull())))
    assert "partial_sum" in text


def test_signature_blocks_need_no_shuffle(spark):
    text = explain(delta.signatures(samples.src_content(spark, SF)))
    assert "Exchange" not in text.split("\n\n")[0]
