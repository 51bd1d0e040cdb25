"""Every query against its SQL twin on the smallest shared tables."""

import pytest
from check_oracles import database, difference

import __spark_entry__ as entry
from loglattice.plans.oracles import ORACLES
from loglattice.plans.queries import QUERIES

# Too few rows at this scale for a hit.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert difference(got, con.execute(ORACLES[name]).df()) is None
    assert len(got) or name in MAY_BE_EMPTY


def test_only_approximate_search_lacks_sql():
    assert set(QUERIES) - set(ORACLES) == {"ann_top_k"}


def test_entry_holds_all_of_them():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_derived_data_has_hits(con):
    def scalar(name, sql):
        return con.execute(f"SELECT {sql} FROM ({ORACLES[name]})").fetchone()[0]

    assert scalar("detect_injection", "count(DISTINCT injection)") >= 3
    assert scalar("flagged_requests", "count(*) FILTER (deflected AND NOT is_injection)") > 0
    assert scalar("rate_limit", "count(*) FILTER (NOT allowed)") > 0
    assert scalar("route_tiers", "count(*) FILTER (needs_interview AND NOT needs_architecture)") > 0
    assert scalar("validate_conversations", "count(DISTINCT reason)") >= 3
    assert scalar("detect_pii", "count(*) FILTER (pii_kinds <> '')") > 0


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
