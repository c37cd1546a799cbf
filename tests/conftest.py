import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import build_session

    s = build_session("local[*]", shuffle_partitions=8)
    # Tests own their checkpoint folder; on a cluster it comes from the session.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="ledgerloom-test-")


def text_frame(spark, columns, rows):
    """An all-text frame with a row-order column ``rid``."""
    data = [(i, *r) for i, r in enumerate(rows)]
    schema = "rid int, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame(data, schema)
