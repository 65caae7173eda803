"""Every query with oracle SQL against DuckDB on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from checks.verify import difference, duck
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not present")


# Models need more labels than the smallest data set has.
LARGER = "/root/testdata/sf0.01"
LEARNERS = {
    "train_classifier", "feature_importance", "mean_importance", "predict_oof", "predict_ensemble", "train_ranker", "recall_of_oof_scores",
}


@pytest.fixture(scope="module")
def con():
    return {d: duck(d) for d in (DATA, LARGER)}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, con, name):
    where = LARGER if name in LEARNERS else DATA
    got = entry.queries()[name](spark, where).toPandas()
    assert difference(got, con[where].execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["aid_x", "aid_y", "wgt"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
