"""Executors need not have the package: kernels travel with their code."""

import os
import subprocess
import sys

from tests_util import ROOT

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from driftline.session import get_spark
spark = get_spark("ship", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
from driftline.operators import delta, packing
from driftline.sources.tree import read_tree
c = spark.createDataFrame([("a", bytearray(b"x" * 2000))], "rel_path string, content binary")
ops = delta.match_blocks(c, delta.match_signatures(c), chunk_bytes=600, reach=512)
assert ops.filter("block_idx < 0").count() == 0
m = spark.createDataFrame([("a", "regular", 5)], "rel_path string, file_type string, size bigint")
assert packing.pack_batches(m).first().batch_id == 0
assert read_tree(spark, sys.argv[1], 1).count() == 1
print("shipped")
"""


def test_workers_outside_the_repository(tmp_path):
    (tmp_path / "only.txt").write_text("x")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "shipped" in out.stdout, out.stderr[-2000:]
