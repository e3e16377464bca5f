"""Tables that grow with the log are never gathered in the driver to be joined."""

import pytest

from kerbline.operators import metrics
from kerbline.plans import fixture, scoring
from kerbline.session import settle

ROWS = 3000


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Events whose tables pack into a few kilobytes."""
    folder = tmp_path_factory.mktemp("log")
    spark.range(ROWS).selectExpr(
        "id AS event_id", "timestamp'2024-01-01 00:00:00' + id * interval 1 minute AS ts", "id % 40 AS user_id",
        "'click' AS event_type", "CAST(id % 50 AS DOUBLE) AS value", "'{}' AS props").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_outcome_is_not_broadcast(spark, log, monkeypatch):
    built = {}

    def kept(df, label):
        built[label] = df
        return settle(df, label)

    monkeypatch.setattr(fixture, "settle", kept)
    t = fixture.Tables(spark, log)
    assert t.outcome.count() == t.clean_table.count() > 0
    plan = _plan(built["outcome"])
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_concordance_is_not_broadcast(spark, log, monkeypatch):
    given = []
    found = metrics.concordance
    monkeypatch.setattr(metrics, "concordance", lambda df, *more: found(given.append(df) or df, *more))
    assert scoring.concordance(spark, log).count() == 1
    plan = _plan(given[0])
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
