"""Intermediate tables live in the configured shared folder and can be dropped."""

from __future__ import annotations

import threading
from functools import partial
from pathlib import Path

import pytest
from cohortwise import session


def test_materialise_and_drop(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    df = session.materialise(spark.range(5).selectExpr("id", "array(id * 0.5D) AS a"), "five")
    home = Path(tmp_path, "cohortwise", spark.sparkContext.applicationId)
    assert home.is_dir() and df.count() == 5 and df.inputFiles()
    session.drop_scratch(spark)
    assert not home.exists()


def test_scratch_root_is_stable(spark):
    assert session.scratch_root(spark) == session.scratch_root(spark)


def test_tune_sets_every_setting(spark):
    session.tune(spark)
    assert all(spark.conf.get(k) == v for k, v in session.SQL_SETTINGS.items())


def test_at_once_runs_side_by_side_in_order(spark):
    """Each job waits for the others; one after the other they would wait in vain."""
    meet = threading.Barrier(3, timeout=60)

    def job(n):
        meet.wait()
        return n, spark.range(n).count(), spark.sparkContext.getLocalProperty("at_once")

    spark.sparkContext.setLocalProperty("at_once", "kept")
    try:
        found = session.at_once(spark, [partial(job, n) for n in (3, 1, 2)])
    finally:
        spark.sparkContext.setLocalProperty("at_once", None)
    assert found == [(3, 3, "kept"), (1, 1, "kept"), (2, 2, "kept")] and session.at_once(spark, []) == []


def test_at_once_raises_after_all_have_ended(spark):
    ended = []

    def fails():
        raise ValueError("no fit")

    with pytest.raises(ValueError, match="no fit"):
        session.at_once(spark, [fails, lambda: ended.append(spark.range(5).count())])
    assert ended == [5]
