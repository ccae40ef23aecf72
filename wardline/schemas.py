"""Schemas of the governance tables. Tables are read with these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, BOOL, DATE, LONG = T.StringType(), T.BooleanType(), T.DateType(), T.LongType()
TS = T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


GRANTS_TO_ROLES = _struct(
    grantee_name=STRING, privilege=STRING, granted_on=STRING, name=STRING,
    table_catalog=STRING, granted_by=STRING, created_on=TS, deleted_on=TS,
)
GRANTS_TO_USERS = _struct(
    grantee_name=STRING, role=STRING, granted_by=STRING, created_on=TS, deleted_on=TS,
)
USERS = _struct(
    name=STRING, type=STRING, disabled=BOOL, created_on=TS, last_success_login=TS,
    has_password=BOOL, has_rsa_public_key=BOOL, has_mfa=BOOL, default_role=STRING,
    default_warehouse=STRING, email=STRING, owner=STRING, deleted_on=TS,
    rsa_public_key_last_set_on=TS,
)
ROLES = _struct(name=STRING, deleted_on=TS)
QUERY_HISTORY = _struct(
    query_id=STRING, user_name=STRING, role_name=STRING, start_time=TS,
    rows_produced=LONG, query_text=STRING, query_type=STRING, execution_status=STRING,
)
ACCESS_HISTORY = _struct(
    query_id=STRING, query_start_time=TS, user_name=STRING,
    base_objects_accessed=T.ArrayType(_struct(objectName=STRING)),
)
LOGIN_HISTORY = _struct(
    user_name=STRING, client_ip=STRING, event_timestamp=TS, is_success=STRING,
    error_code=STRING, error_message=STRING,
)
POLICY_REFERENCES = _struct(
    policy_name=STRING, policy_kind=STRING, ref_database_name=STRING,
    ref_schema_name=STRING, ref_entity_name=STRING, ref_column_name=STRING,
)
TAG_REFERENCES = _struct(
    object_database=STRING, object_schema=STRING, object_name=STRING,
    column_name=STRING, tag_name=STRING, tag_value=STRING,
)
ALERT_HISTORY = _struct(
    name=STRING, scheduled_time=TS, completed_time=TS, state=STRING, error_message=STRING,
)
PATIENT = _struct(
    patient_id=STRING, full_name=STRING, mrn=STRING, dob=DATE, email=STRING,
    facility_id=STRING,
)
ROW_ENTITLEMENTS = _struct(role_name=STRING, facility_id=STRING)
ALERT_STATE = _struct(alert_name=STRING, event_key=STRING, notified_at=TS)

GRANTS = _struct(identity=STRING, role=STRING)
IDENTITIES = _struct(
    login=STRING, is_service=BOOL, entra_object_id=STRING, account_enabled=BOOL,
    last_login=DATE, key_last_set=DATE,
)
EXCEPTIONS = _struct(
    exception_id=STRING, kind=STRING, identity=STRING, role=STRING, severity=STRING,
    sensitivity=STRING, detail=STRING, revoke_sql=STRING, rollback_sql=STRING,
)
APPROVALS = _struct(
    exception_id=STRING, approver=STRING, run_id=STRING, identity=STRING, role=STRING,
    action=STRING, expires=STRING,
)
ROLE_MATRIX = _struct(
    pos=LONG, entra_group_id=STRING, fr_roles=T.ArrayType(STRING), data_sensitivity=STRING,
)
MEMBERSHIP = _struct(group_id=STRING, login=STRING)
SERVICE_INVENTORY = _struct(login_name=STRING, expected_roles=T.ArrayType(STRING))

TABLES = {
    "grants_to_roles": GRANTS_TO_ROLES,
    "grants_to_users": GRANTS_TO_USERS,
    "users": USERS,
    "roles": ROLES,
    "query_history": QUERY_HISTORY,
    "access_history": ACCESS_HISTORY,
    "login_history": LOGIN_HISTORY,
    "policy_references": POLICY_REFERENCES,
    "tag_references": TAG_REFERENCES,
    "alert_history": ALERT_HISTORY,
    "patient": PATIENT,
    "row_entitlements": ROW_ENTITLEMENTS,
    "alert_state": ALERT_STATE,
}
