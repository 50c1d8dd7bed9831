"""Every registered query that has SQL gives the same rows in DuckDB."""

from __future__ import annotations

from pathlib import Path

import __spark_entry__ as entry
import pytest
from compare import difference, duck
from oracle.models import MODEL_SQL

DATA = Path("/root/testdata")
SQL = entry.oracle_sql()
# Fitted models need course groups of at least 20 rows, so they run on the next size up.
FITTED = sorted(MODEL_SQL)
PLAIN = [n for n in SQL if n not in FITTED]

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", PLAIN)
def test_small(spark, name):
    root = str(DATA / "sf0.001")
    assert difference(entry.queries()[name](spark, root), duck(root), SQL[name]) is None


@pytest.mark.parametrize("name", FITTED)
def test_fitted(spark, name):
    root = str(DATA / "sf0.01")
    assert difference(entry.queries()[name](spark, root), duck(root), SQL[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 139
    assert df.columns[:3] == ["client_id", "id_student", "total_clicks"]
