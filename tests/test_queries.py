"""Every named query against its SQL twin on the smallest data set."""

from __future__ import annotations

import json
from functools import cache

import pytest
from check import compare

from __spark_entry__ import entry, oracle_sql, queries
from openchair.oracle import ORACLE_SQL
from openchair.plans import catalog

WITHOUT_TWIN = {"score_model", "recommendations_model"}


@pytest.fixture(scope="module", autouse=True)
def shared_jobs():
    """Queries over the same job reuse its staged tables, which only makes the tests faster."""
    original = catalog._job
    catalog._job = cache(original)
    yield
    catalog._job = original


def test_twins_cover_all_but_the_fitted_scores():
    assert set(catalog.QUERIES) - set(oracle_sql()) == WITHOUT_TWIN
    assert set(oracle_sql()) <= set(queries())
    assert set(catalog.QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sql, sf_dir, name):
    assert compare(spark, sql, name, sf_dir) == ""


def test_entry_returns_recommendations(spark):
    rows = entry(spark).collect()
    assert rows
    for row in rows:
        assert json.loads(row["rationale_codes"])
        assert row["implied_price"] <= row["standard_price"] + 0.01


def test_fitted_model_scores(spark, sf_dir):
    scored = queries()["score_model"](spark, sf_dir).collect()
    fallback = queries()["score_fallback"](spark, sf_dir).collect()
    assert {r["slot_id"] for r in scored} == {r["slot_id"] for r in fallback}
    assert not any(r["used_fallback"] for r in scored)
    assert len({r["booking_probability"] for r in scored}) > 1
    for row in scored:
        for column in ("booking_probability", "shortfall_score", "confidence_score"):
            assert 0.0 <= row[column] <= 1.0
