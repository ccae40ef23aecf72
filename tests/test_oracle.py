import os

import pytest

import __spark_entry__ as entry
from tests.parity import compare, duck
from wardline.plans import catalog, oracle
from wardline.plans.evidence_package import write_package
from wardline.sources.adapter import AS_OF, Tables

DATA = "/root/testdata/sf0.001"
# Few enough users at this scale for these to find nothing.
MAY_BE_EMPTY = {"novel_client_ip", "novel_client_ip_daily", "stale_keys", "sod_violations", "quota_actions"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared test data")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    # The training-data operators have SQL only where it can express them.
    assert set(oracle.oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", catalog.queries())
def test_query_matches_sql(spark, con, name):
    problems = compare(entry.queries()[name](spark, DATA), con, entry.oracle_sql()[name])
    if name in MAY_BE_EMPTY and problems == ["no rows"]:
        problems = []
    assert problems == []


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_name", "effective_role", "access_path"]


def test_evidence_package(spark, tmp_path):
    t = Tables(spark, DATA)
    names = ["grants_to_roles", "grants_to_users", "users", "policy_references", "login_history", "tag_references"]
    tables = {name: getattr(t, name) for name in names}
    header = write_package(tables, str(tmp_path), "2024-01", "ACME", "eu", "reviewer", AS_OF)
    counts = {r.section: r.row_count for r in header.collect()}
    assert len(counts) == 5
    for name, count in counts.items():
        assert spark.read.parquet(str(tmp_path / "period=2024-01" / name)).count() == count
