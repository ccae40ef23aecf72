"""Governance tables derived from a star schema with an event log.

Used where no account history is at hand. Every table is one SELECT over whole
input tables, in SQL that more than one engine understands; ``$TS``, ``$LIST``
and ``$OBJ`` stand for the few names that differ.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30 23:59:59"
TODAY = "2024-01-30"
AI_NAMESPACE = "HOST.AI"
ML_NAMESPACE = "HOST.ML"
PATIENT_TABLE = "RAW_MASKED.GOV.PATIENT"

SPARK_DIALECT = {"$TS": "TIMESTAMP_NTZ", "$LIST": "array", "$OBJ(": "named_struct('objectName', "}


def _user(key: str) -> str:
    return (
        f"CASE WHEN {key} % 25 = 0 THEN 'SVC_' WHEN {key} % 25 = 1 THEN 'BREAKGLASS_' "
        f"ELSE 'USER_' END || CAST({key} AS STRING)"
    )


def _role(nation: str) -> str:
    return f"""CASE CAST({nation} AS INT) WHEN 0 THEN 'FR_CLINICAL_ANALYTICS'
        WHEN 1 THEN 'FR_PLATFORM_ADMIN' WHEN 2 THEN 'FR_BREAKGLASS'
        WHEN 3 THEN 'FR_DBT_TRANSFORM' WHEN 4 THEN 'FR_GOV_ADMIN' WHEN 5 THEN 'FR_ANALYST'
        WHEN 6 THEN 'FR_BI_REPORTING' ELSE 'FR_NATION_' || CAST({nation} AS STRING) END"""


def _access_role(region: str) -> str:
    return f"""CASE CAST({region} AS INT) WHEN 0 THEN 'AR_PHI_UNMASK' WHEN 1 THEN 'AR_RAW_GOV_R'
        WHEN 2 THEN 'AR_MARTS_R' WHEN 3 THEN 'AR_KPIS_R' ELSE 'AR_GOV_ADMIN' END"""


def _group(segment: str, nation: str) -> str:
    return f"'GRP_' || {segment} || '_' || CAST({nation} AS STRING)"


def _day(key: str, span: int) -> str:
    return f"(DATE '{TODAY}' - CAST({key} % {span} AS INT))"


def _time(key: str, span: int) -> str:
    return f"CAST({_day(key, span)} AS $TS)"


def _when(test: str, value: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN {test} THEN {value} ELSE {otherwise} END"


K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

DERIVED = {
    "event_log": f"""
        SELECT event_id, ts, user_id, event_type, value, {K} AS k, {_user('user_id')} AS user_name
        FROM {{events}}""",
    "query_history": f"""
        SELECT 'Q' || CAST(event_id AS STRING) AS query_id, user_name,
          CASE WHEN k < 3 THEN 'ACCOUNTADMIN' WHEN k % 5 = 0 THEN 'R' || CAST(user_id AS STRING)
            ELSE {_role('(k % 7)')} END AS role_name,
          ts AS start_time,
          CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT)
            ELSE CAST(floor(value * 100) AS BIGINT) END AS rows_produced,
          CASE WHEN k = 10 THEN 'ALTER TABLE {PATIENT_TABLE} MODIFY COLUMN MRN UNSET MASKING POLICY'
            WHEN k = 11 THEN 'ALTER TABLE {PATIENT_TABLE} MODIFY COLUMN DOB UNSET TAG GOV.PII_DATE'
            WHEN k = 12 THEN 'SELECT {AI_NAMESPACE}.COMPLETE(note) /* ' || repeat('x', 500) || ' */'
            WHEN k = 13 THEN 'call {ML_NAMESPACE.lower()}.forecast(model_' || CAST(user_id AS STRING) || ')'
            WHEN k = 14 THEN 'alter table t_' || CAST(event_id AS STRING) || ' unset row access policy p'
            ELSE 'SELECT * FROM T_' || CAST(k AS STRING) END AS query_text,
          CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'SHOW'
            WHEN 'signup' THEN 'ALTER' WHEN 'purchase' THEN 'INSERT' ELSE 'SELECT' END AS query_type,
          CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status
        FROM {{event_log}}""",
    "access_history": f"""
        SELECT 'Q' || CAST(event_id AS STRING) AS query_id, ts AS query_start_time, user_name,
          CASE WHEN k % 4 = 0 THEN $LIST($OBJ('{PATIENT_TABLE}'), $OBJ('raw_masked.gov.encounter'),
                 $OBJ('ANALYTICS.MARTS.PATIENTS_BY_FACILITY'))
            WHEN k % 2 = 0 THEN $LIST($OBJ('{PATIENT_TABLE}'),
                 $OBJ('ANALYTICS.MARTS.PATIENTS_BY_FACILITY'))
            ELSE $LIST($OBJ('ANALYTICS.MARTS.PATIENTS_BY_FACILITY')) END AS base_objects_accessed
        FROM {{event_log}}""",
    "login_history": """
        SELECT user_name, '10.' || CAST(k % 3 AS STRING) || '.0.' || CAST(k AS STRING) AS client_ip,
          ts AS event_timestamp,
          CASE WHEN event_type = 'error' THEN 'NO' ELSE 'YES' END AS is_success,
          CASE WHEN event_type = 'error' AND k % 2 = 0 THEN '390195'
            WHEN event_type = 'error' THEN '390100' END AS error_code,
          CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'IP not allowed'
            WHEN event_type = 'error' THEN 'Incorrect username or password' END AS error_message
        FROM {event_log}""",
    "authentication_history": """
        SELECT event_id, ts AS event_timestamp, user_name, event_type, k AS factor FROM {event_log}""",
    "alert_history": """
        SELECT 'ALERT_' || upper(event_type) AS name, ts AS scheduled_time,
          ts + INTERVAL 30 SECOND AS completed_time,
          CASE WHEN k = 0 THEN 'FAILED' ELSE 'TRIGGERED' END AS state,
          CASE WHEN k = 0 THEN 'notification integration is not authorized' END AS error_message
        FROM {event_log}""",
    "alert_state": """
        SELECT 'ALERT_PHI_CONTROL_TAMPER_POLICY_DETACH' AS alert_name,
          'Q' || CAST(event_id AS STRING) AS event_key, ts + INTERVAL 5 MINUTE AS notified_at
        FROM {event_log} WHERE k = 10
        UNION ALL
        SELECT 'ALERT_ACCOUNTADMIN_QUERY', 'Q' || CAST(event_id AS STRING), ts + INTERVAL 5 MINUTE
        FROM {event_log} WHERE k = 1
        UNION ALL
        SELECT 'ALERT_BREAKGLASS_LOGIN', md5(user_name || '|' || CAST(ts AS STRING)),
          ts + INTERVAL 5 MINUTE
        FROM {event_log} WHERE event_type = 'view'""",
    "activity": """
        SELECT 'POOL_' || CAST(user_id % 8 AS STRING) AS user_name,
          CASE WHEN user_id % 8 < 2 THEN 'PRIVILEGED' ELSE 'STANDARD' END AS session_class, ts
        FROM {events}""",
    "users": f"""
        SELECT {_user('c_custkey')} AS name,
          CASE WHEN c_custkey % 25 = 0 THEN 'SERVICE' WHEN c_custkey % 25 = 1 THEN NULL
            ELSE 'PERSON' END AS type,
          c_custkey % 19 = 0 AS disabled, {_time('c_custkey', 900)} AS created_on,
          {_when('c_custkey % 13 <> 0', _time('c_custkey', 200))} AS last_success_login,
          c_custkey % 25 <> 0 AS has_password, c_custkey % 10 = 0 AS has_rsa_public_key,
          c_custkey % 7 <> 0 AS has_mfa, {_role('c_nationkey')} AS default_role,
          'WH_ANALYST' AS default_warehouse,
          'u' || CAST(c_custkey AS STRING) || '@example.com' AS email, c_mktsegment AS owner,
          {_when('c_custkey % 31 = 0', _time('c_custkey', 50))} AS deleted_on,
          {_when('c_custkey % 10 = 0', _time('c_custkey', 800))} AS rsa_public_key_last_set_on
        FROM {{customer}}
        UNION ALL
        SELECT 'SVC_S' || CAST(s_suppkey AS STRING), 'SERVICE', s_suppkey % 17 = 0,
          {_time('s_suppkey', 900)}, {_time('(s_suppkey * 3)', 200)}, FALSE, TRUE, FALSE,
          {_role('s_nationkey')}, 'WH_TRANSFORM', NULL, 'PLATFORM', NULL,
          {_when('s_suppkey % 6 <> 0', _time('(s_suppkey * 9)', 800))}
        FROM {{supplier}}""",
    "roles": f"""
        SELECT {_role('n_nationkey')} AS name, CAST(NULL AS $TS) AS deleted_on FROM {{nation}}
        UNION ALL SELECT {_access_role('r_regionkey')}, NULL FROM {{region}}
        UNION ALL SELECT DISTINCT {_group('c_mktsegment', 'c_nationkey')}, CAST(NULL AS $TS)
        FROM {{customer}}
        UNION ALL SELECT 'R' || CAST(p_partkey AS STRING),
          {_when('p_partkey % 29 = 0', _time('p_partkey', 60))} FROM {{part}}""",
    "grants_to_roles": f"""
        SELECT DISTINCT {_group('c_mktsegment', 'c_nationkey')} AS grantee_name, 'USAGE' AS privilege,
          'ROLE' AS granted_on, {_role('c_nationkey')} AS name,
          CAST(NULL AS STRING) AS table_catalog, 'SECURITYADMIN' AS granted_by,
          {_time('c_nationkey', 400)} AS created_on, CAST(NULL AS $TS) AS deleted_on
        FROM {{customer}}
        UNION ALL
        SELECT {_role('n_nationkey')}, 'USAGE', 'ROLE', {_access_role('n_regionkey')}, NULL,
          'SECURITYADMIN', {_time('n_nationkey', 400)}, NULL FROM {{nation}}
        UNION ALL
        SELECT 'SYSADMIN', 'USAGE', 'ROLE', {_role('n_nationkey')}, NULL, 'SECURITYADMIN',
          {_time('n_nationkey', 400)}, NULL FROM {{nation}} WHERE n_name IN ('NATION_1', 'NATION_3', 'NATION_6')
        UNION ALL
        SELECT 'ACCOUNTADMIN', 'USAGE', 'ROLE',
          CASE WHEN r_regionkey % 2 = 0 THEN 'SYSADMIN' ELSE 'SECURITYADMIN' END, NULL,
          'SECURITYADMIN', {_time('r_regionkey', 400)}, NULL FROM {{region}}
        UNION ALL
        SELECT 'R' || CAST(CAST(floor(p_partkey / 2.0) AS BIGINT) AS STRING), 'USAGE', 'ROLE',
          'R' || CAST(p_partkey AS STRING), NULL, 'USERADMIN', {_time('p_partkey', 400)},
          {_when('p_partkey % 17 = 0', _time('p_partkey', 45))}
        FROM {{part}}
        UNION ALL
        SELECT CASE WHEN p_size <= 5 THEN 'R' || CAST(p_partkey AS STRING)
            ELSE {_access_role('(p_partkey % 5)')} END,
          CASE CAST(p_partkey % 12 AS INT) WHEN 0 THEN 'OWNERSHIP' WHEN 1 THEN 'MANAGE GRANTS'
            WHEN 2 THEN 'CREATE ROLE' ELSE 'SELECT' END,
          'TABLE', 'T_' || CAST(p_partkey AS STRING),
          CASE WHEN p_size <= 5 OR p_partkey % 5 = 1 THEN 'RAW_MASKED' ELSE 'ANALYTICS' END,
          'SYSADMIN', {_time('(p_partkey * 7)', 500)},
          {_when('p_partkey % 23 = 0', _time('p_partkey', 60))}
        FROM {{part}}""",
    "grants_to_users": f"""
        SELECT {_user('c_custkey')} AS grantee_name, {_group('c_mktsegment', 'c_nationkey')} AS role,
          'USERADMIN' AS granted_by, {_time('c_custkey', 365)} AS created_on,
          {_when('c_custkey % 17 = 0', _time('c_custkey', 60))} AS deleted_on
        FROM {{customer}}
        UNION ALL
        SELECT {_user('c_custkey')}, {_role('((c_nationkey + 7) % 25)')}, 'SECURITYADMIN',
          {_time('c_custkey', 200)}, NULL FROM {{customer}} WHERE c_acctbal < 500
        UNION ALL
        SELECT {_user('c_custkey')}, 'R' || CAST(c_custkey AS STRING), 'USERADMIN',
          {_time('c_custkey', 300)}, {_when('c_custkey % 40 = 0', _time('c_custkey', 60))}
        FROM {{customer}}
        UNION ALL
        SELECT {_user('c_custkey')}, 'AR_PHI_UNMASK', 'ACCOUNTADMIN', {_time('c_custkey', 100)},
          {_when('c_custkey % 2 = 0', _time('c_custkey', 20))}
        FROM {{customer}} WHERE c_acctbal > 9500
        UNION ALL
        SELECT 'SVC_S' || CAST(s_suppkey AS STRING), {_role('s_nationkey')}, 'SECURITYADMIN',
          {_time('s_suppkey', 300)}, NULL FROM {{supplier}}""",
    "tag_references": """
        SELECT 'RAW_MASKED' AS object_database, 'GOV' AS object_schema, 'T_' || p_type AS object_name,
          CASE WHEN p_size = 20 THEN NULL ELSE 'C_' || CAST(p_partkey AS STRING) END AS column_name,
          CASE WHEN p_size <= 10 THEN 'PII_STRING' WHEN p_size <= 20 THEN 'PII_DATE'
            ELSE 'DATA_CLASSIFICATION' END AS tag_name,
          CASE WHEN p_size <= 20 THEN lower(p_brand) ELSE 'PHI' END AS tag_value
        FROM {part}
        UNION ALL
        SELECT 'RAW_MASKED', 'GOV', 'PATIENT',
          CASE CAST(r_regionkey AS INT) WHEN 0 THEN 'FULL_NAME' WHEN 1 THEN 'MRN' WHEN 2 THEN 'DOB'
            WHEN 3 THEN 'EMAIL' END,
          CASE CAST(r_regionkey AS INT) WHEN 2 THEN 'PII_DATE' WHEN 4 THEN 'DATA_CLASSIFICATION'
            ELSE 'PII_STRING' END,
          CASE CAST(r_regionkey AS INT) WHEN 4 THEN 'PHI' ELSE 'patient' END
        FROM {region}""",
    "policy_references": """
        SELECT CASE WHEN p_size <= 10 THEN 'MP_PHI_STRING' ELSE 'MP_PHI_DATE' END AS policy_name,
          CASE WHEN p_partkey % 3 = 0 THEN 'AGGREGATION_POLICY' WHEN p_size = 20 THEN 'ROW_ACCESS_POLICY'
            ELSE 'MASKING_POLICY' END AS policy_kind,
          'RAW_MASKED' AS ref_database_name, 'GOV' AS ref_schema_name,
          'T_' || p_type AS ref_entity_name, 'C_' || CAST(p_partkey AS STRING) AS ref_column_name
        FROM {part}
        UNION ALL
        SELECT CASE CAST(r_regionkey AS INT) WHEN 2 THEN 'MP_PHI_DATE' WHEN 4 THEN 'RAP_FACILITY'
            ELSE 'MP_PHI_STRING' END,
          CASE WHEN r_regionkey = 4 THEN 'ROW_ACCESS_POLICY' ELSE 'MASKING_POLICY' END,
          'RAW_MASKED', 'GOV', 'PATIENT',
          CASE CAST(r_regionkey AS INT) WHEN 0 THEN 'FULL_NAME' WHEN 1 THEN 'MRN' WHEN 2 THEN 'DOB'
            WHEN 3 THEN 'EMAIL' END
        FROM {region}""",
    # The bindings as found a month later: those of the largest sizes are gone.
    "policy_references_now": """
        SELECT p.* FROM {policy_references} p LEFT JOIN {part} t
          ON p.ref_column_name = 'C_' || CAST(t.p_partkey AS STRING)
        WHERE t.p_partkey IS NULL OR t.p_size < 45""",
    "classified": """
        SELECT 'RAW_MASKED' AS table_catalog, 'GOV' AS table_schema, 'T_' || p_type AS table_name,
          'C_' || CAST(p_partkey AS STRING) AS column_name,
          CASE WHEN p_size <= 25 THEN 'EMAIL' ELSE 'NAME' END AS semantic_category,
          CASE WHEN p_size <= 40 THEN 'IDENTIFIER' END AS privacy_category
        FROM {part}""",
    "patient": f"""
        SELECT 'P' || CAST(c_custkey AS STRING) AS patient_id, c_name AS full_name,
          {_when('c_custkey % 41 <> 0', "'MRN-' || CAST(900000 + c_custkey AS STRING)")} AS mrn,
          DATE '1940-01-01' + CAST(c_custkey % 20000 AS INT) AS dob,
          'p' || CAST(c_custkey AS STRING) || '@example.com' AS email,
          {_when('c_custkey % 101 <> 0', "'FAC_' || CAST(c_nationkey AS STRING)")} AS facility_id
        FROM {{customer}}""",
    "row_entitlements": f"""
        SELECT {_role('n_nationkey')} AS role_name, 'FAC_' || CAST(n_nationkey AS STRING) AS facility_id
        FROM {{nation}}
        UNION ALL
        SELECT 'FR_CLINICAL_ANALYTICS', 'FAC_' || CAST(n_nationkey AS STRING) FROM {{nation}}
        WHERE n_regionkey = 1""",
    # What queries on patients returned: cleared roles now and then got masked values.
    "returned": f"""
        SELECT {_role('(e.k % 7)')} AS role_name, e.ts AS returned_at,
          CASE WHEN e.k % 7 = 0 AND e.k < 70 THEN p.full_name ELSE '***REDACTED***' END AS full_name,
          CASE WHEN e.k % 7 = 0 AND e.k < 70 THEN p.dob ELSE CAST(date_trunc('year', p.dob) AS DATE)
            END AS dob
        FROM {{event_log}} e JOIN {{patient}} p
          ON p.patient_id = 'P' || CAST(e.user_id AS STRING)""",
    "usage": """
        SELECT CASE l_returnflag WHEN 'A' THEN 'TRANSFORM' WHEN 'N' THEN 'BI' ELSE 'ANALYST' END
          AS workload, l_shipdate AS metered_at, l_quantity AS credits
        FROM {lineitem}""",
    "role_matrix": f"""
        SELECT DISTINCT CAST(c_nationkey AS BIGINT) * 10 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0
            WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS pos,
          {_group('c_mktsegment', 'c_nationkey')} AS entra_group_id,
          CASE WHEN c_mktsegment = 'MACHINERY'
            THEN $LIST(lower({_role('c_nationkey')}), 'FR_ANALYST')
            ELSE $LIST(lower({_role('c_nationkey')})) END AS fr_roles,
          CASE WHEN c_nationkey % 5 = 0 THEN 'phi' WHEN c_mktsegment = 'MACHINERY' THEN 'restricted'
            WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'internal' END AS data_sensitivity
        FROM {{customer}}""",
    "membership": f"""
        SELECT CASE WHEN c_acctbal < 0 THEN {_group('c_mktsegment', '((c_nationkey + 1) % 25)')}
            ELSE {_group('c_mktsegment', 'c_nationkey')} END AS group_id,
          lower({_user('c_custkey')}) AS login
        FROM {{customer}}""",
    "inventory": f"""
        SELECT lower('SVC_S' || CAST(s_suppkey AS STRING)) AS login_name,
          CASE WHEN s_suppkey % 4 = 0 THEN $LIST({_role('s_nationkey')}, 'FR_ANALYST')
            ELSE $LIST({_role('s_nationkey')}) END AS expected_roles
        FROM {{supplier}} WHERE s_acctbal >= 1000""",
    "identities": f"""
        SELECT upper({_user('c_custkey')}) AS login, c_custkey % 25 = 0 AS is_service,
          {_when('c_custkey % 29 <> 0', "'oid-' || CAST(c_custkey AS STRING)")} AS entra_object_id,
          c_custkey % 19 <> 0 AS account_enabled,
          {_when('c_custkey % 13 <> 0', _day('c_custkey', 200))} AS last_login,
          {_when('c_custkey % 25 = 0', _day('c_custkey', 800))} AS key_last_set
        FROM {{customer}} WHERE c_acctbal < 9800
        UNION ALL
        SELECT 'SVC_S' || CAST(s_suppkey AS STRING), TRUE, NULL, TRUE, NULL,
          {_when('s_suppkey % 6 <> 0', _day('(s_suppkey * 9)', 800))}
        FROM {{supplier}} WHERE s_acctbal >= 500""",
    # One approval per direct grant, most of them flawed in one way.
    "approvals": """
        SELECT substr(%SHA%, 1, 16) AS exception_id,
          CASE WHEN n % 7 = 0 THEN 'CI-Bot' ELSE 'manager' END AS approver,
          CASE WHEN n % 7 = 1 THEN '2023-12' ELSE '2024-01' END AS run_id,
          CASE WHEN n % 7 = 2 THEN 'SOMEONE' ELSE lower(identity) END AS identity, role,
          CASE WHEN n % 7 = 3 THEN 'GRANT' WHEN n % 7 = 4 THEN NULL ELSE 'revoke' END AS action,
          CASE WHEN n % 7 = 5 THEN '2024-01-29' WHEN n % 7 = 6 THEN NULL ELSE '2099-12-31' END
            AS expires
        FROM (SELECT DISTINCT upper(grantee_name) AS identity, upper(role) AS role,
                length(grantee_name) + length(role) AS n
              FROM {grants_to_users} WHERE deleted_on IS NULL) g""".replace(
        "%SHA%", "$SHA('OVER_PROVISIONED|' || identity || '|' || role$SHAEND"
    ),
    "cidrs": """
        SELECT 'NP_CORPORATE' AS policy_name, '10.' || CAST(r_regionkey AS STRING) || '.0.0/26' AS cidr
        FROM {region} WHERE r_regionkey < 2
        UNION ALL SELECT 'NP_CORPORATE', '10.2.0.' || CAST(n_nationkey AS STRING) FROM {nation}
        UNION ALL SELECT 'NP_CI_RUNNERS', '10.1.0.' || CAST(n_nationkey * 4 AS STRING) || '/31'
        FROM {nation}""",
    "user_policies": f"""
        SELECT {_user('c_custkey')} AS user_name, 'NP_CI_RUNNERS' AS policy_name
        FROM {{customer}} WHERE c_custkey % 25 = 0""",
    # Wide queries: an order reads one object per line.
    "order_queries": """
        SELECT 'O' || CAST(o_orderkey AS STRING) AS query_id,
          'USER_' || CAST(o_custkey AS STRING) AS user_name, 'FR_ANALYST' AS role_name,
          o_orderdate AS start_time, CAST(floor(o_totalprice) AS BIGINT) AS rows_produced,
          'SELECT ' || o_orderpriority AS query_text, 'SELECT' AS query_type,
          'SUCCESS' AS execution_status
        FROM {orders}""",
    "order_accesses": """
        SELECT 'O' || CAST(o.o_orderkey AS STRING) AS query_id, o.o_orderdate AS query_start_time,
          'USER_' || CAST(o.o_custkey AS STRING) AS user_name,
          CASE WHEN l.l_returnflag = 'R' THEN $LIST($OBJ('RAW_MASKED.GOV.T_' || CAST(l.l_partkey AS STRING)))
            ELSE $LIST($OBJ('ANALYTICS.MARTS.T_' || CAST(l.l_partkey AS STRING))) END
            AS base_objects_accessed
        FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey""",
}
SPARK_DIALECT |= {"$SHAEND": ", 256)", "$SHA(": "sha2("}
REFERENCE = re.compile(r"\{(\w+)\}")


def references(name: str) -> list[str]:
    return sorted(set(REFERENCE.findall(DERIVED[name])))


def translate(name: str, dialect: dict[str, str]) -> str:
    text = DERIVED[name]
    for token, value in dialect.items():
        text = text.replace(token, value)
    return text


class Tables:
    """Governance tables of one data folder, derived on first use."""

    def __init__(self, spark: SparkSession, root: str, **given: DataFrame):
        self.spark, self.root, self._made = spark, root.rstrip("/"), dict(given)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name not in DERIVED:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        inputs = {needed: getattr(self, needed) for needed in references(name)}
        return self.spark.sql(translate(name, SPARK_DIALECT), **inputs)


@lru_cache(maxsize=None)
def required(name: str) -> tuple[str, ...]:
    """Derived tables ``name`` needs, inputs before their users, itself last."""
    order: list[str] = []
    for needed in references(name):
        if needed in DERIVED:
            order += [n for n in required(needed) if n not in order]
    return (*order, name)
