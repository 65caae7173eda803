import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketweave.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-"),
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EVENT_SCHEMA = "session BIGINT, aid INT, ts BIGINT, type INT, event_id BIGINT"


@pytest.fixture()
def events(spark):
    """Build an event log from (session, aid, ts, type) tuples; the tuple order is the tie-break."""

    def make(rows):
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EVENT_SCHEMA)

    return make


@pytest.fixture()
def edges(spark):
    def make(rows):
        return spark.createDataFrame(rows, "aid_x INT, aid_y INT, wgt BIGINT")

    return make


@pytest.fixture()
def conf(spark):
    """Set session options for one test."""
    old = {}

    def put(**options):
        for key, value in options.items():
            name = key.replace("__", ".")
            old.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in old.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def rows(df, *columns):
    """Sorted tuples of the given (or all) columns."""
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())
