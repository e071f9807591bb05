import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from driftline.schemas import MANIFEST  # noqa: E402
from driftline.session import get_spark  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def manifest(spark):
    """Manifest from dicts; a bare string is a small regular file, one ending in / a directory."""
    def make(*entries):
        rows = []
        for e in entries:
            if isinstance(e, str):
                e = {"rel_path": e.rstrip("/"), "file_type": "dir" if e.endswith("/") else "regular"}
            row = {"file_type": "regular", "size": 10 if e.get("file_type", "regular") != "dir" else 0, "mtime_ns": 1,
                   "atime_ns": 1, "mode": 0o644, "uid": 0, "gid": 0, "nlink": 1, "dev": 1, "ino": None, **e}
            rows.append(tuple(row.get(f.name) for f in MANIFEST))
        return spark.createDataFrame(rows, MANIFEST)
    return make
