"""For each query, the same question asked in SQL that DuckDB runs.

Written independently of the operators: closures are recursive, sets of rows
are joined out and made distinct, sessions come from the raw gaps.
"""

from __future__ import annotations

from wardline.constants import (
    ADMIN_ROLES,
    ALERT_MESSAGES,
    DANGEROUS_PRIVILEGES,
    PHI_ENTITLEMENT_SEED,
    PHI_LOGIN_ROLES,
    PHI_NEVER_READ_SEED,
    PROTECTED_ROLES,
)
from wardline.plans.catalog import (
    EXPORT_MONTH,
    LEGACY_AS_OF,
    MATRIX_SHA,
    ORDERS_AS_OF,
    POLL_LOOKBACK_HOURS,
    POLLS,
    QUOTAS,
    RUN_ID,
    RUNNER,
    RUNS,
)
from wardline.plans.oracle_tables import with_tables
from wardline.sources.adapter import AI_NAMESPACE, AS_OF, ML_NAMESPACE, TODAY

# Stated here as well, so that a text that is wrong in the operator shows.
DETAIL_OVER = "Holds a role that no approved group or inventory entry gives."
DETAIL_UNDER = "Should hold this role, and does not."
DETAIL_UNMANAGED = "Service login that nobody has registered."
DETAIL_ORPHAN = "Person without an enabled directory entry."

NOW = f"TIMESTAMP '{AS_OF}'"


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _seed(values) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{v}')" for v in values) + ") v(role_name)"


def _ago(days: float) -> str:
    return f"{NOW} - INTERVAL {days} DAY"


def _climb(seed: str, edges: str = "edges") -> str:
    """Recursive closure as the body of a table (top_role, reachable_role)."""
    return f"""(top_role, reachable_role) AS
        SELECT role_name, role_name FROM {seed} UNION
        SELECT e.parent_role, c.reachable_role FROM {edges} e
        JOIN {{self}} c ON e.child_role = c.top_role"""


def _closure(name: str, seed: str, edges: str = "edges") -> str:
    return _climb(seed, edges).replace("{self}", name)


def _down(name: str, seed: str, source: str) -> str:
    return f"""(held, effective) AS
        SELECT role_name, role_name FROM {seed} UNION
        SELECT c.held, upper(g.name) FROM {source} g
        JOIN {name} c ON upper(g.grantee_name) = c.effective
        WHERE g.granted_on = 'ROLE' AND g.privilege = 'USAGE' AND g.deleted_on IS NULL"""


def _mask(table: str, unmask: bool) -> str:
    if unmask:
        return "patient_id, full_name, mrn, dob, email, facility_id"
    return (
        "patient_id, '***REDACTED***' AS full_name, '***REDACTED***' AS mrn, "
        "make_date(CAST(year(dob) AS INTEGER), 1, 1) AS dob, '***REDACTED***' AS email, facility_id"
    )


_PRIVILEGES = """SELECT DISTINCT c.held AS role, g.privilege, g.granted_on, g.name
    FROM {closure} c JOIN {source} g ON upper(g.grantee_name) = c.effective
    WHERE g.deleted_on IS NULL AND NOT (g.granted_on = 'ROLE' AND g.privilege = 'USAGE')"""

_EVENT = "alert_name, event_key, user_name, client_ip, query_text, event_timestamp"


# Written for this engine, apart from the operator's recognisers: one after the other.
SCRUBBED = [
    (r"(?i)(token|password|passwd|pwd|secret|api[ _-]?key|access[ _-]?key)[\"'']? *[=:] *(\"[^\"\n]*\"|''[^''\n]*''|\"?[^\s\"]+\"?)", "[SECRET]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    (r"([0-9]{1,3}\.){3}[0-9]{1,3}", "[IP]"),
    (r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[PHONE]"),
    (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[SSN]"),
    (r"MRN-?[0-9]+", "[MRN]"),
    (r"[0-9]{12}[0-9]*", "[NUMBER]"),
]


def _scrub(column: str) -> str:
    text = column
    for pattern, marker in SCRUBBED:
        text = f"regexp_replace({text}, '{pattern}', '{marker}', 'g')"
    return text


def _line(actor: str, label: str, value: str) -> str:
    return (
        f"'{actor}: ' || user_name || ' | {label}: ' || {value} || ' | Time: ' "
        "|| CAST(event_timestamp AS VARCHAR)"
    )


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _fold(rows: str, by: str = "") -> str:
    """Digest of table ``rows`` (hash column ``h``), folded by prefixes of 6, 3 and 0 digits."""
    g = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
      SELECT {g}CAST(sum(n) AS BIGINT) AS row_count,
        sha256(string_agg(p || ':' || node, ',' ORDER BY p || ':' || node)) AS sha256
      FROM (SELECT {g}substr(p, 1, 3) AS p, sum(n) AS n,
              sha256(string_agg(p || ':' || node, ',' ORDER BY p || ':' || node)) AS node
            FROM (SELECT {g}substr(h, 1, 6) AS p, sum(n) AS n,
                    sha256(string_agg(h || ':' || CAST(n AS VARCHAR), ','
                      ORDER BY h || ':' || CAST(n AS VARCHAR))) AS node
                  FROM (SELECT {g}h, count(*) AS n FROM {rows} GROUP BY {g}h) a
                  GROUP BY {g}substr(h, 1, 6)) b
            GROUP BY {g}substr(p, 1, 3)) c
      {group}"""


def _row_hash(columns: list[str]) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in sorted(columns)]
    parts = [f"coalesce(CAST(length({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


_EXCEPTION_COLUMNS = [
    "exception_id", "kind", "identity", "role", "severity", "sensitivity", "detail",
    "revoke_sql", "rollback_sql",
]
_HISTORY_COLUMNS = [
    "query_id", "user_name", "role_name", "start_time", "rows_produced", "query_text",
    "query_type", "execution_status",
]

# Named expressions the queries below share.
SHARED = {
    "edges": """SELECT name AS child_role, grantee_name AS parent_role FROM grants_to_roles
        WHERE granted_on = 'ROLE' AND privilege = 'USAGE' AND deleted_on IS NULL""",
    "phi_seed": """SELECT DISTINCT grantee_name AS role_name FROM grants_to_roles
        WHERE deleted_on IS NULL AND (table_catalog = 'RAW_MASKED' OR name ILIKE '%PHI%')""",
    "phi_closure": _closure("phi_closure", "phi_seed"),
    "admin_seed": _seed(ADMIN_ROLES),
    "admin_closure": _closure("admin_closure", "admin_seed"),
    "entitlement_seed": _seed(PHI_ENTITLEMENT_SEED),
    "entitlement_closure": _closure("entitlement_closure", "entitlement_seed"),
    "unread_seed": _seed(PHI_NEVER_READ_SEED),
    "unread_closure": _closure("unread_closure", "unread_seed"),
    "login_seed": _seed(PHI_LOGIN_ROLES),
    "login_closure": _closure("login_closure", "login_seed"),
    "duty_seed": _seed(("AR_PHI_UNMASK", "AR_GOV_ADMIN")),
    "duty_closure": _closure("duty_closure", "duty_seed"),
    "user_roles": """SELECT DISTINCT upper(grantee_name) AS identity, upper(role) AS role_name
        FROM grants_to_users WHERE deleted_on IS NULL""",
    "user_role_names": "SELECT DISTINCT role_name FROM user_roles",
    "user_role_tree": _down("user_role_tree", "user_role_names", "grants_to_roles"),
    "actual": """SELECT DISTINCT u.identity, t.effective AS role
        FROM user_roles u JOIN user_role_tree t ON u.role_name = t.held""",
    "all_roles": "SELECT DISTINCT name AS role_name FROM roles WHERE deleted_on IS NULL",
    "all_role_tree": _down("all_role_tree", "all_roles", "grants_to_roles"),
    "legacy_grants": f"""SELECT grantee_name, privilege, granted_on, name,
          CAST(NULL AS TIMESTAMP) AS deleted_on FROM grants_to_roles
        WHERE created_on <= TIMESTAMP '{LEGACY_AS_OF}'
          AND (deleted_on IS NULL OR deleted_on > TIMESTAMP '{LEGACY_AS_OF}')""",
    "legacy_tree": _down("legacy_tree", "all_roles", "legacy_grants"),
    "new_privileges": _PRIVILEGES.format(closure="all_role_tree", source="grants_to_roles"),
    "old_privileges": _PRIVILEGES.format(closure="legacy_tree", source="legacy_grants"),
    "accessed": """SELECT query_id, query_start_time, user_name,
          unnest(base_objects_accessed).objectName AS object_name FROM access_history""",
    "order_accessed": """SELECT query_id, query_start_time, user_name,
          unnest(base_objects_accessed).objectName AS object_name FROM order_accesses""",
    "phi_queries": f"""SELECT DISTINCT q.query_id, q.user_name, q.start_time, q.rows_produced
        FROM query_history q JOIN accessed a
          ON q.query_id = a.query_id AND q.start_time = a.query_start_time
        WHERE (q.start_time >= {_ago(30)} AND q.start_time <= {NOW}) AND a.object_name ILIKE 'RAW_MASKED.GOV.%'""",
    "daily_volume": f"""SELECT user_name, CAST(start_time AS DATE) AS d, sum(rows_produced) AS n
        FROM query_history WHERE (start_time >= {_ago(8)} AND start_time <= {NOW})
          AND NOT (user_name ILIKE 'SVC_%' OR user_name ILIKE '%_SVC' OR user_name ILIKE 'BREAKGLASS_%')
        GROUP BY 1, 2""",
    "breakglass": """SELECT 'ALERT_BREAKGLASS_LOGIN' AS alert_name,
          md5(user_name || '|' || CAST(event_timestamp AS VARCHAR)) AS event_key, user_name,
          client_ip, CAST(NULL AS VARCHAR) AS query_text, event_timestamp
        FROM login_history WHERE user_name ILIKE 'BREAKGLASS%' AND is_success = 'YES'""",
    "policy_detach": """SELECT 'ALERT_PHI_CONTROL_TAMPER_POLICY_DETACH' AS alert_name,
          query_id AS event_key, user_name, CAST(NULL AS VARCHAR) AS client_ip, query_text,
          start_time AS event_timestamp
        FROM query_history WHERE execution_status = 'SUCCESS'
          AND (query_text ILIKE '%UNSET MASKING POLICY%'
            OR query_text ILIKE '%UNSET ROW ACCESS POLICY%')""",
    "tag_unset": """SELECT 'ALERT_PHI_CONTROL_TAMPER_TAG_REMOVAL' AS alert_name,
          query_id AS event_key, user_name, CAST(NULL AS VARCHAR) AS client_ip, query_text,
          start_time AS event_timestamp
        FROM query_history WHERE execution_status = 'SUCCESS'
          AND (query_text ILIKE '%UNSET TAG%PII_STRING%' OR query_text ILIKE '%UNSET TAG%PII_DATE%')""",
    "admin_session": """SELECT 'ALERT_ACCOUNTADMIN_QUERY' AS alert_name,
          query_id AS event_key, user_name, CAST(NULL AS VARCHAR) AS client_ip, query_text,
          start_time AS event_timestamp
        FROM query_history WHERE execution_status = 'SUCCESS' AND role_name = 'ACCOUNTADMIN'
          AND query_type NOT IN ('SHOW', 'DESCRIBE', 'USE')""",
    "all_alerts": """SELECT * FROM breakglass UNION ALL SELECT * FROM policy_detach
        UNION ALL SELECT * FROM tag_unset UNION ALL SELECT * FROM admin_session""",
    "message_lines": f"""SELECT alert_name, line, count(*) AS copies
        FROM (SELECT alert_name, {_case('alert_name', {
            'ALERT_BREAKGLASS_LOGIN': _line('User', 'IP', 'client_ip'),
            'ALERT_PHI_CONTROL_TAMPER_POLICY_DETACH': _line('Actor', 'SQL', 'left(query_text, 200)'),
            'ALERT_PHI_CONTROL_TAMPER_TAG_REMOVAL': _line('Actor', 'SQL', 'left(query_text, 200)'),
            'ALERT_ACCOUNTADMIN_QUERY': _line('User', 'Query', 'left(query_text, 150)'),
          })} AS line FROM all_alerts) x GROUP BY 1, 2""",
    "message_totals": """SELECT alert_name, CAST(sum(copies) AS BIGINT) AS event_count,
          CAST(ceil(count(*) / 100.0) AS BIGINT) AS message_count FROM message_lines GROUP BY 1""",
    "matrix_roles": """SELECT pos, entra_group_id, coalesce(data_sensitivity, 'internal') AS sens,
          upper(unnest(fr_roles)) AS role, generate_subscripts(fr_roles, 1) AS place FROM role_matrix""",
    "expected": """SELECT DISTINCT upper(m.login) AS identity, r.role
        FROM membership m JOIN matrix_roles r ON m.group_id = r.entra_group_id
        UNION SELECT upper(login_name), upper(unnest(expected_roles)) FROM inventory""",
    "sensitivity": """SELECT role, arg_max(sens, pos * 1000 + place) AS sensitivity
        FROM matrix_roles GROUP BY role""",
    "managed": """SELECT DISTINCT identity, role FROM actual
        WHERE role IN (SELECT role FROM expected)""",
    "service_list": "SELECT DISTINCT upper(login_name) AS login FROM inventory",
    "people": """SELECT i.*, i.is_service OR s.login IS NOT NULL AS service
        FROM identities i LEFT JOIN service_list s ON i.login = s.login""",
    "login_findings": f"""SELECT identity, kind, detail FROM (
          SELECT a.identity,
            CASE WHEN p.login IS NULL AND s.login IS NULL THEN 'UNMANAGED_SVC'
              WHEN p.service AND DATE '{TODAY}' - p.key_last_set > 365 THEN 'STALE_KEY'
              WHEN p.login IS NULL OR p.service THEN NULL
              WHEN p.entra_object_id IS NULL OR NOT p.account_enabled THEN 'ORPHAN'
              WHEN DATE '{TODAY}' - p.last_login > 90 THEN 'STALE' END AS kind,
            CASE WHEN p.login IS NULL AND s.login IS NULL THEN '{DETAIL_UNMANAGED}'
              WHEN p.service AND DATE '{TODAY}' - p.key_last_set > 365 THEN
                'Signing key is ' || CAST(DATE '{TODAY}' - p.key_last_set AS VARCHAR)
                || ' days old: set on ' || CAST(p.key_last_set AS VARCHAR) || '.'
              WHEN p.entra_object_id IS NULL OR NOT p.account_enabled THEN '{DETAIL_ORPHAN}'
              ELSE 'Last seen on ' || CAST(p.last_login AS VARCHAR) || '; the limit is 90 days.' END AS detail
          FROM (SELECT DISTINCT identity FROM actual) a
          LEFT JOIN people p ON a.identity = p.login
          LEFT JOIN service_list s ON a.identity = s.login) f
        WHERE kind IS NOT NULL""",
    "findings": f"""SELECT 'OVER_PROVISIONED' AS kind, identity, role, '{DETAIL_OVER}' AS detail
          FROM (SELECT * FROM managed EXCEPT SELECT * FROM expected) o
        UNION ALL SELECT 'UNDER_PROVISIONED', identity, role, '{DETAIL_UNDER}'
          FROM (SELECT * FROM expected EXCEPT SELECT * FROM managed) u
        UNION ALL SELECT kind, identity, NULL, detail FROM login_findings""",
    "found": f"""SELECT
          substr(sha256(f.kind || '|' || f.identity || '|' || coalesce(f.role, '')), 1, 16)
            AS exception_id,
          f.kind, f.identity, f.role,
          CASE WHEN s.sensitivity = 'phi' OR f.role IN ({_names(PROTECTED_ROLES)}) THEN 'CRITICAL'
            ELSE CASE f.kind WHEN 'ORPHAN' THEN 'CRITICAL' WHEN 'STALE' THEN 'MEDIUM'
              WHEN 'UNDER_PROVISIONED' THEN 'LOW' ELSE 'HIGH' END END AS severity,
          coalesce(s.sensitivity, 'unknown') AS sensitivity, f.detail,
          CASE WHEN f.kind = 'OVER_PROVISIONED' THEN
            'REVOKE ROLE "' || f.role || '" FROM USER "' || f.identity || '";' END AS revoke_sql,
          CASE WHEN f.kind = 'OVER_PROVISIONED' THEN
            'GRANT ROLE "' || f.role || '" TO USER "' || f.identity || '";' END AS rollback_sql
        FROM findings f LEFT JOIN sensitivity s ON f.role = s.role""",
    "checked": f"""SELECT a.exception_id, a.approver,
          CASE WHEN lower(a.approver) = '{RUNNER}' THEN 'SEPARATION_OF_DUTIES'
            WHEN a.run_id IS DISTINCT FROM '{RUN_ID}' THEN 'WRONG_RUN'
            WHEN upper(a.identity) <> e.identity OR upper(a.role) <> coalesce(e.role, '')
              THEN 'GRANT_MISMATCH'
            WHEN upper(coalesce(a.action, 'REVOKE')) <> 'REVOKE' THEN 'WRONG_ACTION'
            WHEN a.expires < '{TODAY}' THEN 'EXPIRED' END AS reason
        FROM approvals a JOIN found e ON a.exception_id = e.exception_id""",
    "run_list": "SELECT * FROM (VALUES "
    + ", ".join(f"({at}, '{run}')" for at, run in enumerate(RUNS))
    + ") v(bit, run_id)",
    "review_history": """SELECT r.run_id, f.exception_id, f.kind, f.severity, r.bit
        FROM found f CROSS JOIN run_list r
        WHERE (CAST('0x' || substr(f.exception_id, 1, 2) AS INTEGER) >> r.bit) & 1 = 1""",
    "clinical_facilities": """SELECT e.facility_id FROM row_entitlements e
        WHERE upper(e.role_name) IN
          (SELECT effective FROM all_role_tree WHERE held = 'FR_CLINICAL_ANALYTICS')""",
    "staged": f"SELECT {_mask('patient', False)} FROM patient",
    "clean_mart": """SELECT facility_id, count(DISTINCT patient_id) AS patient_count,
          {now} AS mart_refreshed_at FROM patient GROUP BY facility_id""".replace("{now}", NOW),
    "ips": """SELECT *, CAST(split_part(client_ip, '.', 1) AS BIGINT) * 16777216
          + CAST(split_part(client_ip, '.', 2) AS BIGINT) * 65536
          + CAST(split_part(client_ip, '.', 3) AS BIGINT) * 256
          + CAST(split_part(client_ip, '.', 4) AS BIGINT) AS address FROM login_history""",
    "networks": """SELECT policy_name, low, low + CAST(pow(2, 32 - bits) AS BIGINT) - 1 AS high
        FROM (SELECT policy_name, bits, ip - ip % CAST(pow(2, 32 - bits) AS BIGINT) AS low
          FROM (SELECT policy_name,
              CASE WHEN cidr LIKE '%/%' THEN CAST(split_part(cidr, '/', 2) AS INTEGER) ELSE 32 END AS bits,
              CAST(split_part(cidr, '.', 1) AS BIGINT) * 16777216
              + CAST(split_part(cidr, '.', 2) AS BIGINT) * 65536
              + CAST(split_part(cidr, '.', 3) AS BIGINT) * 256
              + CAST(split_part(split_part(cidr, '.', 4), '/', 1) AS BIGINT) AS ip FROM cidrs) a) b""",
    "history_rows": f"""SELECT CAST(start_time AS DATE) AS event_date,
          {_row_hash(_HISTORY_COLUMNS)} AS h FROM query_history""",
    "evidence_hashes": f"SELECT {_row_hash(_EXCEPTION_COLUMNS)} AS h FROM found",
}

SHARED["month_rows"] = f"""SELECT * FROM history_rows
    WHERE strftime(event_date, '%Y-%m') = '{EXPORT_MONTH}'"""
SHARED["teams"] = """SELECT DISTINCT login AS identity,
      'TEAM_' || CAST(ascii(right(login, 1)) % 5 AS VARCHAR) AS owner
    FROM identities WHERE length(login) % 7 <> 0"""
SHARED["owned_history"] = """SELECT h.run_id, f.identity, h.severity, coalesce(t.owner, 'UNOWNED') AS owner
    FROM review_history h JOIN found f ON h.exception_id = f.exception_id AND h.kind = f.kind
    LEFT JOIN teams t ON f.identity = t.identity"""

QUERIES = {
    "role_edges": "SELECT child_role, parent_role FROM edges",
    "phi_role_seed": "SELECT role_name FROM phi_seed",
    "role_closure": "SELECT DISTINCT top_role, reachable_role FROM phi_closure",
    "phi_access_report": """SELECT DISTINCT g.grantee_name AS user_name, c.top_role AS effective_role,
          CASE WHEN c.top_role = c.reachable_role THEN 'DIRECT' ELSE 'INHERITED' END AS access_path
        FROM phi_closure c JOIN grants_to_users g ON c.top_role = g.role AND g.deleted_on IS NULL""",
    "privileged_access": """SELECT DISTINCT g.grantee_name AS user_name, c.top_role AS privileged_role,
          CASE WHEN c.top_role = c.reachable_role THEN 'DIRECT' ELSE 'INHERITED' END AS access_path,
          u.disabled, u.has_mfa, u.last_success_login
        FROM admin_closure c JOIN grants_to_users g ON c.top_role = g.role AND g.deleted_on IS NULL
        LEFT JOIN users u ON g.grantee_name = u.name AND u.deleted_on IS NULL""",
    "phi_entitlements": """SELECT DISTINCT g.grantee_name AS user_name,
          c.reachable_role AS phi_role_reached, g.role AS granted_via_role, u.disabled,
          u.last_success_login
        FROM entitlement_closure c
        JOIN grants_to_users g ON c.top_role = g.role AND g.deleted_on IS NULL
        JOIN users u ON g.grantee_name = u.name AND u.deleted_on IS NULL""",
    "phi_never_read": f"""SELECT m.user_name, 'HAS PHI ROLE, NO PHI ACCESS IN 90 DAYS' AS finding
        FROM (SELECT DISTINCT g.grantee_name AS user_name FROM grants_to_users g
              JOIN unread_closure c ON g.role = c.top_role WHERE g.deleted_on IS NULL) m
        LEFT JOIN (SELECT DISTINCT user_name FROM accessed WHERE (query_start_time >= {_ago(90)} AND query_start_time <= {NOW})
              AND object_name ILIKE 'RAW_MASKED.GOV.%') r ON m.user_name = r.user_name
        WHERE r.user_name IS NULL""",
    "effective_grants": "SELECT identity, role FROM actual",
    "effective_privileges": "SELECT role, privilege, granted_on, name FROM new_privileges",
    "service_users": """SELECT u.name AS service_user, u.type, u.has_password, u.has_rsa_public_key,
          u.has_mfa, u.disabled, u.default_role, u.default_warehouse, u.owner, u.last_success_login,
          coalesce(string_agg(DISTINCT g.role, ', ' ORDER BY g.role), '') AS roles_held
        FROM users u LEFT JOIN grants_to_users g
          ON u.name = g.grantee_name AND g.deleted_on IS NULL
        WHERE u.deleted_on IS NULL AND (u.type = 'SERVICE'
          OR (u.has_rsa_public_key = TRUE AND u.has_password = FALSE)
          OR u.name ILIKE 'SVC_%' OR u.name ILIKE '%_SVC' OR u.name ILIKE '%SERVICE%')
        GROUP BY ALL""",
    "dormant_users": f"""SELECT name AS user_name, type, disabled, created_on, last_success_login,
          date_diff('day', last_success_login, {NOW}) AS days_since_login, default_role, owner
        FROM users WHERE deleted_on IS NULL AND disabled = FALSE
          AND (last_success_login IS NULL OR last_success_login < {_ago(90)})""",
    "grant_changes": f"""SELECT 'GRANT_TO_ROLE' AS change_scope, created_on, deleted_on,
          CASE WHEN deleted_on IS NULL THEN 'ADDED' ELSE 'REVOKED' END AS grant_action,
          grantee_name AS role_name, privilege, granted_on AS object_type, name AS object_name,
          granted_by
        FROM grants_to_roles WHERE (created_on >= {_ago(30)} AND created_on <= {NOW}) OR (deleted_on >= {_ago(30)} AND deleted_on <= {NOW})
        UNION ALL
        SELECT 'GRANT_TO_USER', created_on, deleted_on,
          CASE WHEN deleted_on IS NULL THEN 'ADDED' ELSE 'REVOKED' END,
          grantee_name, 'ROLE', 'USER', role, granted_by
        FROM grants_to_users WHERE (created_on >= {_ago(30)} AND created_on <= {NOW}) OR (deleted_on >= {_ago(30)} AND deleted_on <= {NOW})""",
    "unused_roles": f"""SELECT r.name AS role_name, 'NO QUERIES IN 90 DAYS' AS finding
        FROM roles r LEFT JOIN (SELECT DISTINCT role_name FROM query_history
          WHERE (start_time >= {_ago(90)} AND start_time <= {NOW}) AND role_name IS NOT NULL) u ON r.name = u.role_name
        WHERE r.deleted_on IS NULL AND u.role_name IS NULL AND NOT starts_with(r.name, 'AR_')""",
    "over_privileged_roles": f"""SELECT grantee_name AS role_name, count(*) AS privilege_count,
          string_agg(DISTINCT privilege, ', ' ORDER BY privilege) AS privilege_list
        FROM grants_to_roles WHERE deleted_on IS NULL
          AND privilege IN ({_names(DANGEROUS_PRIVILEGES)}) GROUP BY grantee_name""",
    "attestation_header": f"""SELECT 'ACME' AS account, 'eu-central' AS region,
          {NOW} AS review_run_at, 'reviewer' AS reviewer,
          'HIPAA Monthly Access Review' AS review_type, section, row_count
        FROM (SELECT 'user_roster' AS section, count(*) AS row_count FROM users
            WHERE deleted_on IS NULL
          UNION ALL SELECT 'phi_entitlements', count(*) FROM (
            SELECT DISTINCT g.grantee_name, c.reachable_role, g.role, u.disabled, u.last_success_login
            FROM entitlement_closure c
            JOIN grants_to_users g ON c.top_role = g.role AND g.deleted_on IS NULL
            JOIN users u ON g.grantee_name = u.name AND u.deleted_on IS NULL) e
          UNION ALL SELECT 'policy_evidence', count(*) FROM policy_references
            WHERE policy_kind IN ('MASKING_POLICY', 'ROW_ACCESS_POLICY')
          UNION ALL SELECT 'failed_logins', count(*) FROM (
            SELECT user_name FROM login_history WHERE (event_timestamp >= {_ago(30)} AND event_timestamp <= {NOW})
              AND is_success = 'NO' GROUP BY user_name HAVING count(*) >= 5) l
          UNION ALL SELECT 'tagged_unmasked', count(*) FROM tag_references t
            WHERE t.tag_name IN ('PII_STRING', 'PII_DATE') AND t.column_name IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM policy_references p
                WHERE p.ref_database_name = t.object_database AND p.ref_schema_name = t.object_schema
                  AND p.ref_entity_name = t.object_name AND p.ref_column_name = t.column_name
                  AND p.policy_kind = 'MASKING_POLICY')) s""",
    "user_roster": """SELECT name AS user_name, type, disabled, created_on, last_success_login,
          has_password, has_rsa_public_key, has_mfa, default_role, email, owner
        FROM users WHERE deleted_on IS NULL""",
    "policy_evidence": """SELECT policy_name, policy_kind, ref_database_name, ref_schema_name,
          ref_entity_name, ref_column_name
        FROM policy_references WHERE policy_kind IN ('MASKING_POLICY', 'ROW_ACCESS_POLICY')""",
    "failed_logins": f"""SELECT user_name, count(*) AS failed_logins,
          count(DISTINCT client_ip) AS distinct_ips, min(event_timestamp) AS first_failure,
          max(event_timestamp) AS last_failure
        FROM login_history WHERE (event_timestamp >= {_ago(30)} AND event_timestamp <= {NOW}) AND is_success = 'NO'
        GROUP BY user_name HAVING count(*) >= 5""",
    "tagged_unmasked": """SELECT t.object_database, t.object_schema, t.object_name, t.column_name,
          t.tag_name, t.tag_value
        FROM tag_references t LEFT JOIN policy_references p
          ON t.object_database = p.ref_database_name AND t.object_schema = p.ref_schema_name
          AND t.object_name = p.ref_entity_name AND t.column_name = p.ref_column_name
          AND p.policy_kind = 'MASKING_POLICY'
        WHERE t.tag_name IN ('PII_STRING', 'PII_DATE') AND t.column_name IS NOT NULL
          AND p.policy_name IS NULL""",
    "mfa_posture": """SELECT name AS user_name, type, has_mfa, has_password, has_rsa_public_key,
          default_role, last_success_login
        FROM users WHERE deleted_on IS NULL AND disabled = FALSE AND type = 'PERSON'""",
    "recent_failed_logins": f"""SELECT user_name, error_code, error_message, client_ip, event_timestamp
        FROM login_history WHERE (event_timestamp >= {_ago(7)} AND event_timestamp <= {NOW}) AND is_success = 'NO'""",
    "recent_auth_events": f"""SELECT * FROM authentication_history
        WHERE (event_timestamp >= {_ago(2)} AND event_timestamp <= {NOW})""",
    "recent_logins": f"""SELECT client_ip, user_name, event_timestamp, is_success, error_code
        FROM login_history WHERE (event_timestamp > {_ago(2)} AND event_timestamp <= {NOW})""",
    "alert_run_history": f"""SELECT name AS alert_name, scheduled_time, completed_time, state,
          error_message
        FROM alert_history WHERE (scheduled_time >= {_ago(7)} AND scheduled_time <= {NOW})""",
    "column_tag_check": """SELECT * FROM tag_references
        WHERE column_name = 'MRN' AND tag_name IN ('PII_STRING', 'PII_DATE')""",
    "policies_on": """SELECT * FROM policy_references
        WHERE ref_entity_name = 'PATIENT' AND ref_schema_name = 'GOV'""",
    "grant_snapshot": """SELECT 'GRANT_TO_ROLE' AS grant_scope, grantee_name, privilege, granted_on,
          name, table_catalog, granted_by, created_on
        FROM grants_to_roles WHERE deleted_on IS NULL
        UNION ALL SELECT 'GRANT_TO_USER', grantee_name, NULL, NULL, role, NULL, granted_by, created_on
        FROM grants_to_users WHERE deleted_on IS NULL""",
    "volume_spike": f"""SELECT t.user_name, CAST(t.n AS BIGINT) AS rows_today,
          b.mean AS avg_7d_baseline, t.n / b.mean AS multiple_of_baseline,
          'DATA_VOLUME_SPIKE' AS signal
        FROM (SELECT user_name, n FROM daily_volume WHERE d = DATE '{TODAY}') t
        JOIN (SELECT user_name, avg(n) AS mean, stddev_samp(n) AS dev FROM daily_volume
              WHERE d < DATE '{TODAY}' GROUP BY user_name) b ON t.user_name = b.user_name
        WHERE b.mean > 0 AND t.n > b.mean + 2 * coalesce(b.dev, 0)""",
    "off_hours_access": """SELECT user_name, query_start_time, CAST(h AS INTEGER) AS hour_local,
          CASE dow WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday'
            WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' ELSE 'Saturday' END
            AS day_of_week,
          CAST(n AS BIGINT) AS rows_produced, 'OFF_HOURS_PHI_ACCESS' AS signal
        FROM (SELECT user_name, start_time AS query_start_time, hour(start_time) AS h,
                dayofweek(start_time) AS dow, sum(rows_produced) AS n
              FROM phi_queries WHERE NOT (user_name ILIKE 'SVC_%' OR user_name ILIKE 'BREAKGLASS_%')
              GROUP BY ALL) s
        WHERE h NOT BETWEEN 6 AND 21 OR dow IN (0, 6)""",
    "novel_client_ip": f"""SELECT r.user_name, r.client_ip AS novel_ip, r.seen AS first_seen,
          'NOVEL_CLIENT_IP' AS signal
        FROM (SELECT user_name, client_ip, max(event_timestamp) AS seen FROM login_history
              WHERE (event_timestamp >= {_ago(1)} AND event_timestamp <= {NOW}) AND is_success = 'YES' GROUP BY 1, 2) r
        JOIN (SELECT DISTINCT grantee_name AS user_name FROM grants_to_users WHERE deleted_on IS NULL
              AND role IN ({_names(PHI_LOGIN_ROLES)})) p ON r.user_name = p.user_name
        LEFT JOIN (SELECT DISTINCT user_name, client_ip FROM login_history
              WHERE event_timestamp < {_ago(1)} AND is_success = 'YES') h
          ON r.user_name = h.user_name AND r.client_ip = h.client_ip
        WHERE h.client_ip IS NULL""",
    "novel_client_ip_inherited": f"""SELECT r.user_name, r.client_ip AS novel_ip,
          r.seen AS first_seen, 'NOVEL_CLIENT_IP' AS signal
        FROM (SELECT user_name, client_ip, max(event_timestamp) AS seen FROM login_history
              WHERE (event_timestamp >= {_ago(1)} AND event_timestamp <= {NOW}) AND is_success = 'YES' GROUP BY 1, 2) r
        JOIN (SELECT DISTINCT g.grantee_name AS user_name FROM grants_to_users g
              JOIN login_closure c ON g.role = c.top_role WHERE g.deleted_on IS NULL) p
          ON r.user_name = p.user_name
        LEFT JOIN (SELECT DISTINCT user_name, client_ip FROM login_history
              WHERE event_timestamp < {_ago(1)} AND is_success = 'YES') h
          ON r.user_name = h.user_name AND r.client_ip = h.client_ip
        WHERE h.client_ip IS NULL""",
    "mass_export": f"""SELECT DISTINCT a.user_name, a.query_start_time, q.rows_produced,
          left(q.query_text, 300) AS query_text_excerpt, q.query_id, 'MASS_EXPORT' AS signal
        FROM accessed a JOIN query_history q
          ON a.query_id = q.query_id AND a.query_start_time = q.start_time
        WHERE (a.query_start_time >= {_ago(30)} AND a.query_start_time <= {NOW}) AND a.object_name ILIKE 'RAW_MASKED.GOV.%'
          AND q.rows_produced > 10000
          AND NOT (a.user_name ILIKE 'SVC_%' OR a.user_name ILIKE 'BREAKGLASS_%')""",
    "mass_export_orders": f"""SELECT DISTINCT a.user_name, a.query_start_time, q.rows_produced,
          left(q.query_text, 300) AS query_text_excerpt, q.query_id, 'MASS_EXPORT' AS signal
        FROM order_accessed a JOIN order_queries q
          ON a.query_id = q.query_id AND a.query_start_time = q.start_time
        WHERE a.query_start_time >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 3650 DAY
          AND a.query_start_time <= TIMESTAMP '{ORDERS_AS_OF}'
          AND a.object_name ILIKE 'RAW_MASKED.GOV.%' AND q.rows_produced > 10000
          AND NOT (a.user_name ILIKE 'SVC_%' OR a.user_name ILIKE 'BREAKGLASS_%')""",
    "empty_result_probe": """SELECT user_name, query_date, total_queries, zero_row_queries,
          floor(CAST(zero_row_queries AS DOUBLE) / total_queries * 1000 + 0.5) / 10 AS pct_empty,
          'HIGH_EMPTY_RESULT_RATE' AS signal
        FROM (SELECT user_name, CAST(start_time AS DATE) AS query_date, count(*) AS total_queries,
                CAST(sum(CASE WHEN rows_produced = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_row_queries
              FROM phi_queries GROUP BY 1, 2) p
        WHERE zero_row_queries > 1
          AND CAST(zero_row_queries AS DOUBLE) / nullif(total_queries, 0) > 0.5""",
    "untagged_sensitive": """SELECT c.*, 'UNTAGGED_PHI_CANDIDATE' AS signal
        FROM classified c LEFT JOIN (SELECT * FROM tag_references
          WHERE tag_name IN ('PII_STRING', 'PII_DATE') AND column_name IS NOT NULL) t
          ON c.table_catalog = t.object_database AND c.table_schema = t.object_schema
          AND c.table_name = t.object_name AND c.column_name = t.column_name
        WHERE t.column_name IS NULL AND c.privacy_category IS NOT NULL""",
    "classify_columns": r"""SELECT 'email' AS column_name, 'EMAIL' AS semantic_category,
          'IDENTIFIER' AS privacy_category,
          avg(CAST(regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') AS DOUBLE))
            AS match_ratio FROM patient
        UNION ALL SELECT 'mrn', 'MEDICAL_RECORD', 'IDENTIFIER',
          avg(CAST(regexp_matches(mrn, '^MRN-?[0-9]+$') AS DOUBLE)) FROM patient
        UNION ALL SELECT 'full_name', 'NAME', 'IDENTIFIER',
          avg(CAST(regexp_matches(full_name, '^[A-Z][a-z]+( [A-Z][a-z]+)+$') AS DOUBLE)) FROM patient
        UNION ALL SELECT DISTINCT 'dob', 'DATE_OF_BIRTH', 'QUASI_IDENTIFIER', CAST(NULL AS DOUBLE)
        FROM patient""",
    "classify_by_profile": r"""SELECT * FROM (
          SELECT 'email' AS column_name, 'EMAIL' AS semantic_category, 'IDENTIFIER' AS privacy_category,
            0.75 * avg(CASE WHEN email LIKE '%_@_%._%' THEN 1.0 WHEN trim(email) <> '' THEN 0.0 END) + 0.25 AS score,
            'NAME_AND_VALUES' AS evidence FROM patient
          UNION ALL SELECT 'mrn', 'MEDICAL_RECORD', 'IDENTIFIER',
            0.75 * avg(CASE WHEN starts_with(mrn, 'MRN') THEN 1.0 WHEN trim(mrn) <> '' THEN 0.0 END) + 0.25,
            'NAME_AND_VALUES' FROM patient
          UNION ALL SELECT 'full_name', 'NAME', 'IDENTIFIER',
            0.75 * avg(CASE WHEN regexp_matches(full_name, '^[A-Z][a-z]+( [A-Z][a-z]+)+$') THEN 1.0
              WHEN trim(full_name) <> '' THEN 0.0 END) + 0.25, 'NAME_AND_VALUES' FROM patient
          UNION ALL SELECT 'dob', 'DATE_OF_BIRTH', 'QUASI_IDENTIFIER',
            0.5 * avg(CASE WHEN year(dob) BETWEEN 1900 AND 2099 THEN 1.0 ELSE 0.0 END) + 0.5,
            'NAME_AND_VALUES' FROM patient) c
        WHERE score >= 0.6""",
    "ai_function_calls": f"""SELECT user_name, role_name, start_time,
          left(query_text, 400) AS query_excerpt
        FROM query_history WHERE (start_time >= {_ago(30)} AND start_time <= {NOW})
          AND (query_text ILIKE '%{AI_NAMESPACE}.COMPLETE%'
            OR query_text ILIKE '%{AI_NAMESPACE}.SUMMARIZE%'
            OR query_text ILIKE '%{AI_NAMESPACE}.CLASSIFY_TEXT%'
            OR query_text ILIKE '%{AI_NAMESPACE}.EXTRACT_ANSWER%'
            OR query_text ILIKE '%{AI_NAMESPACE}.EMBED_TEXT%')""",
    "ml_training_calls": f"""SELECT user_name, role_name, start_time, query_text
        FROM query_history WHERE (start_time >= {_ago(30)} AND start_time <= {NOW})
          AND (query_text ILIKE '%{ML_NAMESPACE}.FORECAST%'
            OR query_text ILIKE '%{ML_NAMESPACE}.ANOMALY_DETECTION%'
            OR query_text ILIKE '%{ML_NAMESPACE}.CLASSIFICATION%')""",
    "ai_calls_on_phi": f"""SELECT DISTINCT a.user_name, a.query_start_time,
          a.object_name AS accessed_object, left(q.query_text, 300) AS query_excerpt
        FROM accessed a JOIN query_history q
          ON q.query_id = a.query_id AND q.start_time = a.query_start_time
        WHERE (a.query_start_time >= {_ago(30)} AND a.query_start_time <= {NOW}) AND a.object_name ILIKE 'RAW_MASKED.%'
          AND q.query_text ILIKE '%{AI_NAMESPACE}.%'""",
    "alert_breakglass": "SELECT * FROM breakglass",
    "alert_policy_detach": "SELECT * FROM policy_detach",
    "alert_tag_unset": "SELECT * FROM tag_unset",
    "alert_admin_session": "SELECT * FROM admin_session",
    "alert_new_events": f"""SELECT {_EVENT} FROM all_alerts a
        WHERE (event_timestamp > {_ago(30)} AND event_timestamp <= {NOW})
          AND NOT EXISTS (SELECT 1 FROM alert_state s
          WHERE s.alert_name = a.alert_name AND s.event_key = a.event_key)""",
    "alert_notifications": f"""SELECT alert_name,
          {_case('alert_name', {n: f"'{s}'" for n, (s, _) in ALERT_MESSAGES.items()})} AS subject,
          event_count, message_no, message_count,
          {_case('alert_name', {n: f"'{o}'" for n, (_, o) in ALERT_MESSAGES.items()})}
            || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY text) AS body
        FROM (SELECT l.alert_name, t.event_count, t.message_count,
            CAST('0x' || substr(md5(l.line), 1, 8) AS BIGINT) % t.message_count + 1 AS message_no,
            l.line || CASE WHEN l.copies > 1 THEN ' (x' || CAST(l.copies AS VARCHAR) || ')' ELSE '' END
              AS text
          FROM message_lines l JOIN message_totals t ON l.alert_name = t.alert_name) m
        GROUP BY alert_name, event_count, message_no, message_count""",
    "alert_stream": f"SELECT DISTINCT {_EVENT} FROM all_alerts",
    "alert_replay": f"""SELECT e.alert_name, e.event_key, p.poll AS reported_at
        FROM (SELECT DISTINCT alert_name, event_key, client_ip, event_timestamp
              FROM all_alerts) e
        JOIN (SELECT unnest([{", ".join(f"TIMESTAMP '{p}'" for p in POLLS)}]) AS poll) p
          ON e.event_timestamp <= p.poll
          AND e.event_timestamp > p.poll - INTERVAL {POLL_LOOKBACK_HOURS} HOUR
        QUALIFY p.poll = min(p.poll) OVER (PARTITION BY e.alert_name, e.event_key)""",
    "mask_patient": "SELECT * FROM staged",
    "row_access": """SELECT * FROM patient WHERE facility_id IN (
          SELECT e.facility_id FROM row_entitlements e WHERE upper(e.role_name) IN
            (SELECT effective FROM all_role_tree WHERE held IN ('FR_NATION_7', 'FR_NATION_8')))""",
    "session_roles": """SELECT s.session_id, t.effective AS role, bool_or(s.is_primary) AS in_primary
        FROM (SELECT name AS session_id, upper(default_role) AS role, TRUE AS is_primary FROM users
                WHERE deleted_on IS NULL
              UNION ALL SELECT grantee_name, upper(role), FALSE FROM grants_to_users
                WHERE deleted_on IS NULL) s
        JOIN session_tree t ON s.role = t.held GROUP BY 1, 2""",
    "protected_patient_admin": "SELECT * FROM staged",
    "protected_patient_clinical": """SELECT * FROM patient
        WHERE facility_id IN (SELECT facility_id FROM clinical_facilities)""",
    "visibility_report": """SELECT f.held AS role,
          CASE WHEN f.sees_all THEN (SELECT count(*) FROM patient) ELSE coalesce(v.n, 0) END
            AS rows_visible, f.columns_clear
        FROM (SELECT held, bool_or(effective IN
                ('FR_PLATFORM_ADMIN', 'FR_BREAKGLASS', 'FR_DBT_TRANSFORM')) AS sees_all,
                bool_or(effective = 'AR_PHI_UNMASK') AS columns_clear
              FROM all_role_tree GROUP BY held) f
        LEFT JOIN (SELECT s.held, count(*) AS n FROM
                (SELECT DISTINCT t.held, e.facility_id FROM all_role_tree t
                  JOIN row_entitlements e ON upper(e.role_name) = t.effective) s
              JOIN patient p ON p.facility_id = s.facility_id GROUP BY s.held) v ON f.held = v.held""",
    "stg_patients": """SELECT patient_id, full_name AS patient_name, mrn, email AS patient_email,
          dob AS date_of_birth, facility_id FROM staged""",
    "patients_by_facility": "SELECT * FROM clean_mart",
    "column_tests": """SELECT 'patient' AS table_name, 'patient_id' AS column_name,
          'not_null' AS test, count(*) AS failures FROM patient WHERE patient_id IS NULL
        UNION ALL SELECT 'patient', 'facility_id', 'not_null', count(*) FROM patient
          WHERE facility_id IS NULL
        UNION ALL SELECT 'patient', 'patient_id', 'unique', count(*) FROM
          (SELECT patient_id FROM patient WHERE patient_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) a
        UNION ALL SELECT 'patients_by_facility', 'facility_id', 'not_null', count(*) FROM clean_mart
          WHERE facility_id IS NULL
        UNION ALL SELECT 'patients_by_facility', 'patient_count', 'not_null', count(*) FROM clean_mart
          WHERE patient_count IS NULL
        UNION ALL SELECT 'patients_by_facility', 'mart_refreshed_at', 'not_null', count(*)
          FROM clean_mart WHERE mart_refreshed_at IS NULL
        UNION ALL SELECT 'patients_by_facility', 'facility_id', 'unique', count(*) FROM
          (SELECT facility_id FROM clean_mart WHERE facility_id IS NOT NULL
           GROUP BY 1 HAVING count(*) > 1) b""",
    "expected_grants": "SELECT identity, role FROM expected",
    "role_sensitivity": "SELECT role, sensitivity FROM sensitivity",
    "over_provisioned": """SELECT identity, role, revoke_sql, rollback_sql FROM found
        WHERE kind = 'OVER_PROVISIONED'""",
    "under_provisioned": "SELECT identity, role FROM found WHERE kind = 'UNDER_PROVISIONED'",
    "unmanaged_service": "SELECT identity, detail FROM login_findings WHERE kind = 'UNMANAGED_SVC'",
    "stale_keys": "SELECT identity, detail FROM login_findings WHERE kind = 'STALE_KEY'",
    "orphans": "SELECT identity, detail FROM login_findings WHERE kind = 'ORPHAN'",
    "stale_humans": "SELECT identity, detail FROM login_findings WHERE kind = 'STALE'",
    "review_exceptions": "SELECT * FROM found",
    "service_accounts": """SELECT upper(name) AS login, TRUE AS is_service,
          CAST(NULL AS VARCHAR) AS entra_object_id, TRUE AS account_enabled,
          CAST(NULL AS DATE) AS last_login, CAST(rsa_public_key_last_set_on AS DATE) AS key_last_set
        FROM users WHERE type = 'SERVICE' AND deleted_on IS NULL AND disabled = FALSE""",
    "valid_approvals": """SELECT exception_id, approver, reason IS NULL AS valid, reason
        FROM checked""",
    "remediation_plan": f"""SELECT f.exception_id, f.identity, f.role, c.approver, f.rollback_sql,
          f.revoke_sql
        FROM found f JOIN checked c ON f.exception_id = c.exception_id AND c.reason IS NULL
        WHERE f.kind = 'OVER_PROVISIONED' AND f.role NOT IN ({_names(PROTECTED_ROLES)})
          AND f.severity <> 'CRITICAL'
          AND EXISTS (SELECT 1 FROM user_roles u WHERE u.identity = f.identity AND u.role_name = f.role)""",
    "exception_report": """SELECT exception_id, kind, severity, sensitivity, identity, role, detail
        FROM found""",
    "evidence_digest": f"""SELECT '{RUN_ID}' AS run_id, '{MATRIX_SHA}' AS role_matrix_commit,
          row_count AS exception_count, sha256 FROM ({_fold('evidence_hashes')}) d""",
    "review_summary": """SELECT count(*) AS exception_count,
          count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
          CASE WHEN count(*) FILTER (WHERE severity = 'CRITICAL') > 0 THEN 2 ELSE 0 END AS exit_code
        FROM found""",
    "logins_outside_allowlist": """SELECT l.user_name, l.client_ip, l.event_timestamp, l.is_success,
          l.policy_name
        FROM (SELECT i.*, coalesce(u.policy_name, 'NP_CORPORATE') AS policy_name
              FROM ips i LEFT JOIN user_policies u ON i.user_name = u.user_name) l
        WHERE NOT EXISTS (SELECT 1 FROM networks n WHERE n.policy_name = l.policy_name
          AND l.address BETWEEN n.low AND n.high)""",
    "quota_actions": f"""SELECT workload, CAST(date_trunc('month', hour) AS DATE) AS usage_month,
          step_pct, action, min(hour) AS reached_at, min(used) AS credits_used
        FROM (SELECT workload, hour, sum(credits) OVER (
                PARTITION BY workload, date_trunc('month', hour) ORDER BY hour) AS used
              FROM (SELECT workload, date_trunc('hour', metered_at) AS hour, sum(credits) AS credits
                    FROM usage GROUP BY 1, 2) h) u
        JOIN (VALUES (80, 'NOTIFY'), (100, 'SUSPEND'), (110, 'SUSPEND_IMMEDIATE')) s(step_pct, action)
          ON used * 100 >= step_pct * {_case('workload', {k: str(v) for k, v in QUOTAS.items()})}
          AND (step_pct <= 100 OR workload = 'TRANSFORM')
        GROUP BY ALL""",
    "idle_sessions": """SELECT user_name, session_class, session_no, min(ts) AS session_start,
          max(ts) AS session_end, count(*) AS events
        FROM (SELECT *, CAST(sum(starts) OVER (PARTITION BY user_name, session_class ORDER BY ts
                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
              FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (
                      PARTITION BY user_name, session_class ORDER BY ts) <= CASE session_class
                      WHEN 'PRIVILEGED' THEN INTERVAL 15 MINUTE ELSE INTERVAL 30 MINUTE END
                      THEN 0 ELSE 1 END AS starts FROM activity) a) b
        GROUP BY ALL""",
    "privilege_diff": """SELECT *, 'GAINED' AS change FROM
          (SELECT * FROM new_privileges EXCEPT SELECT * FROM old_privileges) g
        UNION ALL SELECT *, 'LOST' FROM
          (SELECT * FROM old_privileges EXCEPT SELECT * FROM new_privileges) l""",
    "sod_violations": f"""SELECT 'USER_REACHES_BOTH' AS finding, g.grantee_name AS subject,
          'AR_PHI_UNMASK+AR_GOV_ADMIN' AS role
        FROM grants_to_users g JOIN duty_closure c ON g.role = c.top_role
        WHERE g.deleted_on IS NULL
        GROUP BY g.grantee_name HAVING count(DISTINCT c.reachable_role) = 2
        UNION ALL SELECT 'ADMIN_REACHES', top_role, reachable_role FROM duty_closure
        WHERE top_role IN ({_names(ADMIN_ROLES[:5])})""",
    "control_drift": """SELECT policy_name, ref_database_name, ref_schema_name, ref_entity_name,
          ref_column_name, 'MASKING_POLICY_REMOVED' AS finding
        FROM (SELECT DISTINCT policy_name, ref_database_name, ref_schema_name, ref_entity_name,
                ref_column_name FROM policy_references WHERE policy_kind = 'MASKING_POLICY'
              EXCEPT SELECT DISTINCT policy_name, ref_database_name, ref_schema_name,
                ref_entity_name, ref_column_name FROM policy_references_now
              WHERE policy_kind = 'MASKING_POLICY') d""",
    "exception_aging": """SELECT exception_id, kind, min(run_id) AS first_seen,
          max(run_id) AS last_seen, count(DISTINCT run_id) AS runs_seen
        FROM review_history GROUP BY 1, 2""",
    "exception_report_aged": f"""SELECT f.exception_id, f.kind, f.severity, f.identity, f.role,
          a.first_seen, a.runs_seen
        FROM found f JOIN review_history h ON f.exception_id = h.exception_id AND f.kind = h.kind
          AND h.run_id = '{RUNS[-1]}'
        JOIN (SELECT exception_id, kind, min(run_id) AS first_seen,
                count(DISTINCT run_id) AS runs_seen FROM review_history GROUP BY 1, 2) a
          ON f.exception_id = a.exception_id AND f.kind = a.kind""",
    "review_counts_by_team": """SELECT run_id, NULL AS owner, NULL AS severity, 'run' AS level,
          count(*) AS exceptions, count(DISTINCT identity) AS identities
        FROM owned_history GROUP BY run_id
        UNION ALL SELECT run_id, owner, NULL, 'team', count(*), count(DISTINCT identity)
        FROM owned_history GROUP BY run_id, owner
        UNION ALL SELECT run_id, owner, severity, 'severity', count(*), count(DISTINCT identity)
        FROM owned_history GROUP BY run_id, owner, severity""",
    "evidence_changes": f"""SELECT f.exception_id, f.kind, f.identity, f.role, f.severity,
          CASE WHEN bool_or(h.run_id = '{RUNS[-1]}') THEN 'NEW' ELSE 'GONE' END AS change
        FROM found f JOIN review_history h ON f.exception_id = h.exception_id AND f.kind = h.kind
        WHERE h.run_id IN ('{RUNS[-2]}', '{RUNS[-1]}')
        GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 1""",
    "evidence_proofs": f"""SELECT f.exception_id, {_row_hash(_EXCEPTION_COLUMNS)} AS row_hash,
          d.sha256, TRUE AS proven
        FROM found f CROSS JOIN ({_fold('evidence_hashes')}) d""",
    "owner_reports": """SELECT coalesce(t.owner, 'UNOWNED') AS owner, f.exception_id, f.kind,
          f.identity, f.role, f.severity
        FROM found f LEFT JOIN teams t ON f.identity = t.identity""",
    "materialized_mart": "SELECT * FROM clean_mart",
    "export_history": f"""SELECT 'query_history' AS history, event_date, row_count, sha256
        FROM ({_fold('month_rows', 'event_date')}) d""",
    "review_counts": """SELECT run_id, kind, severity, count(*) AS exceptions FROM review_history
        GROUP BY run_id, kind, severity
        UNION ALL SELECT run_id, kind, NULL, count(*) FROM review_history GROUP BY run_id, kind
        UNION ALL SELECT run_id, NULL, NULL, count(*) FROM review_history GROUP BY run_id""",
    "review_metrics": """SELECT kind, severity, count(*) AS episodes,
          count(*) FILTER (WHERE days IS NULL) AS open_episodes,
          avg(CAST(days AS DOUBLE)) AS mean_days_to_remediate,
          avg(CASE WHEN days IS NOT NULL THEN CASE WHEN days <= 31 THEN 1.0 ELSE 0.0 END END)
            AS share_in_sla
        FROM (SELECT exception_id, kind, severity,
                CASE WHEN max(bit) < 4 THEN date_diff('day', min(first), max(first) + INTERVAL 1 MONTH)
                  END AS days
              FROM (SELECT *, CAST(run_id || '-01' AS DATE) AS first,
                      bit - row_number() OVER (PARTITION BY exception_id ORDER BY bit) AS island
                    FROM review_history) a
              GROUP BY exception_id, kind, severity, island) b
        GROUP BY kind, severity""",
    "history_digest": f"""SELECT 'query_history' AS history, event_date, row_count, sha256
        FROM ({_fold('history_rows', 'event_date')}) d""",
    "scrub_text": f"""SELECT doc_id, {_scrub('text')} AS text, lang, source, n_chars,
          {_scrub('text')} IS DISTINCT FROM text AS scrubbed FROM documents""",
    "scrub_conversations": f"""SELECT conv_id, turn, role, {_scrub('text')} AS text,
          {_scrub('text')} IS DISTINCT FROM text AS scrubbed FROM conversations""",
    "small_cohorts": """SELECT facility_id, CAST(year(dob) AS INTEGER) AS birth_year,
          count(*) AS cohort_size
        FROM patient GROUP BY 1, 2 HAVING count(*) < 5""",
    "redaction_rate": """SELECT role_name, CAST(returned_at AS DATE) AS day,
          count(*) AS rows_returned,
          CAST(sum(CASE WHEN full_name = '***REDACTED***' THEN 1 ELSE 0 END
            + CASE WHEN month(dob) = 1 AND day(dob) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS masked_values,
          sum(CASE WHEN full_name = '***REDACTED***' THEN 1 ELSE 0 END
            + CASE WHEN month(dob) = 1 AND day(dob) = 1 THEN 1 ELSE 0 END)
            / CAST(count(*) * 2 AS DOUBLE) AS masked_share
        FROM returned GROUP BY 1, 2""",
}

# The same rows, found another way.
for _name, _same in (
    ("novel_client_ip_daily", "novel_client_ip"), ("volume_spike_daily", "volume_spike"),
    ("exception_aging_by_run", "exception_aging"),
):
    QUERIES[_name] = QUERIES[_same]

SHARED["session_role_names"] = """SELECT DISTINCT upper(default_role) AS role_name FROM users
    WHERE deleted_on IS NULL UNION SELECT DISTINCT upper(role) FROM grants_to_users
    WHERE deleted_on IS NULL"""
SHARED["session_tree"] = _down("session_tree", "session_role_names", "grants_to_roles")


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(sql, SHARED) for name, sql in QUERIES.items()}
