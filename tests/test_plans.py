"""The plans Spark makes: what reaches the scans, and how often they are read."""

import pytest

from tests.conftest import rows
from wardline import schemas
from wardline.functions import salted_join
from wardline.operators import anomaly, audit, protect, rolegraph

NOW = "2024-01-30 12:00:00"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, make, tmp_path):
    def store(schema, *rows_in):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        make(schema, *rows_in).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    return store


@pytest.fixture
def histories(stored):
    at = "2024-01-29 03:00:00"
    return (
        stored(schemas.QUERY_HISTORY, ("q", "u", "FR_A", at, 20_000, "SELECT 1", "SELECT", "SUCCESS")),
        stored(schemas.ACCESS_HISTORY, ("q", at, "u", [("RAW_MASKED.GOV.PATIENT",)])),
    )


def test_window_and_columns_reach_the_scan(histories):
    text = plan(anomaly.volume_spike(histories[0], NOW))
    assert "GreaterThanOrEqual(start_time,2024-01-22T12:00" in text
    assert "ReadSchema: struct<user_name:string,start_time:timestamp_ntz,rows_produced:bigint>" in text
    assert text.count("FileScan") == 1


def test_signals_never_explode_objects(histories):
    for found in (
        anomaly.off_hours_access(*histories, NOW, "UTC"),
        anomaly.mass_export(*histories, NOW),
        anomaly.empty_result_probe(*histories, NOW),
    ):
        text = plan(found)
        assert "Generate" not in text and "CartesianProduct" not in text
        assert text.count("FileScan") == 2
        assert text.count("GreaterThanOrEqual") >= 2


def test_new_address_reads_logins_once(stored):
    logins = stored(schemas.LOGIN_HISTORY, ("u", "1.1.1.1", NOW, "YES", None, None))
    grants = stored(schemas.GRANTS_TO_USERS, ("u", "AR_PHI_UNMASK", "s", None, None))
    assert plan(anomaly.novel_client_ip(logins, grants, NOW)).count("FileScan") == 2
    text = plan(audit.failed_logins(logins, NOW))
    assert "EqualTo(is_success,NO)" in text and "GreaterThanOrEqual(event_timestamp" in text


def test_filters_pass_through_a_protected_read(spark, stored, make):
    patients = stored(schemas.PATIENT, ("P1", "n", "m", None, "e", "FAC_A"), ("P2", "n", "m", None, "e", "FAC_B"))
    grants = make(
        schemas.GRANTS_TO_ROLES, ("FR_C", "USAGE", "ROLE", "AR_PHI_UNMASK", None, "s", None, None)
    )
    session = protect.SessionRoles.resolve(spark, rolegraph.role_edges(grants), "FR_C")
    seen = protect.protect(
        patients, make(schemas.TAG_REFERENCES), make(schemas.ROW_ENTITLEMENTS, ("FR_C", "FAC_A")),
        "A.B.PATIENT", session,
    )
    assert rows(seen, "patient_id") == [("P1",)]
    text = plan(seen.filter("patient_id = 'P1'").select("patient_id"))
    assert "EqualTo(patient_id,P1)" in text
    assert "ReadSchema: struct<patient_id:string,facility_id:string>" in text
    assert "BroadcastHashJoin" in text


def test_hot_key_is_spread(spark):
    """Two thirds of the rows share a key; no task of the join may hold most of them."""
    facts = spark.range(0, 30_000, 1, 16).selectExpr("CASE WHEN id % 3 > 0 THEN 0 ELSE id END AS k")
    lookup = spark.range(0, 30_000).selectExpr("id AS k", "id AS v")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                          "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")

        def largest(df):
            return max(df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())

        assert largest(facts.join(lookup, "k")) > 20_000
        assert largest(salted_join(facts, lookup, ["k"])) < 10_000
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
