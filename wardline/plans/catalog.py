"""Every operator as a named query over the derived governance tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import session
from wardline.functions import live
from wardline.operators import (
    alerts,
    anomaly,
    audit,
    conformance,
    evidence,
    incremental,
    marts,
    profiling,
    protect,
    review,
    rolegraph,
    usage,
)
from wardline.sources import history, sinks
from wardline.sources.adapter import (
    AI_NAMESPACE,
    AS_OF,
    ML_NAMESPACE,
    PATIENT_TABLE,
    TODAY,
    Tables,
)
from wardline.sources.publish import publish, read_published
from wardline.streaming.alert_stream import read_alerts, read_stream, start_alert_stream

Query = Callable[[Tables], DataFrame]
REGISTRY: dict[str, Query] = {}
REVIEW_DAY = dt.date.fromisoformat(TODAY)
RUN_ID, RUNNER, MATRIX_SHA = "2024-01", "ci-bot", "0f1e2d3c"
RUNS = ("2023-09", "2023-10", "2023-11", "2023-12", "2024-01")
ORDERS_AS_OF = "2002-01-01 00:00:00"
LEGACY_AS_OF = "2023-11-30 00:00:00"
QUOTAS = {"TRANSFORM": 4000.0, "BI": 3000.0, "ANALYST": 3000.0}
MANY = 10**12
POLLS = ("2024-01-10 12:00:00", "2024-01-20 00:00:00", "2024-01-28 18:30:00")
POLL_LOOKBACK_HOURS = 240
STREAM_FILES = 8
EXPORT_MONTH = "2024-01"
#: Days that the incremental findings add one by one, after what they begin with.
ADDED_DAYS = ("2024-01-28", "2024-01-29", "2024-01-30")
TEAMS = 5


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


# Role graph ------------------------------------------------------------------


@query
def role_edges(t: Tables) -> DataFrame:
    return rolegraph.role_edges(t.grants_to_roles)


@query
def phi_role_seed(t: Tables) -> DataFrame:
    return rolegraph.phi_role_seed(t.grants_to_roles)


@query
def role_closure(t: Tables) -> DataFrame:
    return rolegraph.role_closure(
        rolegraph.phi_role_seed(t.grants_to_roles), rolegraph.role_edges(t.grants_to_roles)
    )


@query
def phi_access_report(t: Tables) -> DataFrame:
    return rolegraph.phi_access_report(t.grants_to_roles, t.grants_to_users)


@query
def privileged_access(t: Tables) -> DataFrame:
    return rolegraph.privileged_access_report(t.grants_to_roles, t.grants_to_users, t.users)


@query
def phi_entitlements(t: Tables) -> DataFrame:
    return rolegraph.phi_entitlement_extract(t.grants_to_roles, t.grants_to_users, t.users)


@query
def phi_never_read(t: Tables) -> DataFrame:
    return rolegraph.phi_granted_never_read(
        t.grants_to_roles, t.grants_to_users, t.access_history, AS_OF
    )


@query
def effective_grants(t: Tables) -> DataFrame:
    return rolegraph.effective_grants(t.grants_to_users, t.grants_to_roles)


def _all_roles(t: Tables) -> DataFrame:
    return live(t.roles).select(F.col("name").alias("role_name")).distinct()


@query
def effective_privileges(t: Tables) -> DataFrame:
    return rolegraph.effective_privileges(_all_roles(t), t.grants_to_roles)


# Audit -----------------------------------------------------------------------


@query
def service_users(t: Tables) -> DataFrame:
    return audit.service_users(t.users, t.grants_to_users)


@query
def dormant_users(t: Tables) -> DataFrame:
    return audit.dormant_users(t.users, AS_OF)


@query
def grant_changes(t: Tables) -> DataFrame:
    return audit.grant_changes(t.grants_to_roles, t.grants_to_users, AS_OF)


@query
def unused_roles(t: Tables) -> DataFrame:
    return audit.unused_roles(t.roles, t.query_history, AS_OF)


@query
def over_privileged_roles(t: Tables) -> DataFrame:
    return audit.over_privileged_roles(t.grants_to_roles)


@query
def attestation_header(t: Tables) -> DataFrame:
    sections = {
        "user_roster": audit.user_roster(t.users),
        "phi_entitlements": phi_entitlements(t),
        "policy_evidence": audit.policy_evidence(t.policy_references),
        "failed_logins": audit.failed_logins(t.login_history, AS_OF),
        "tagged_unmasked": tagged_unmasked(t),
    }
    return audit.attestation_header(sections, "ACME", "eu-central", "reviewer", AS_OF)


@query
def user_roster(t: Tables) -> DataFrame:
    return audit.user_roster(t.users)


@query
def policy_evidence(t: Tables) -> DataFrame:
    return audit.policy_evidence(t.policy_references)


@query
def failed_logins(t: Tables) -> DataFrame:
    return audit.failed_logins(t.login_history, AS_OF)


@query
def tagged_unmasked(t: Tables) -> DataFrame:
    return audit.tagged_unmasked_columns(t.tag_references, t.policy_references)


@query
def mfa_posture(t: Tables) -> DataFrame:
    return audit.mfa_posture(t.users)


@query
def recent_failed_logins(t: Tables) -> DataFrame:
    return audit.recent_failed_logins(t.login_history, AS_OF)


@query
def recent_auth_events(t: Tables) -> DataFrame:
    return audit.recent_auth_events(t.authentication_history, AS_OF, hours=48)


@query
def recent_logins(t: Tables) -> DataFrame:
    return audit.recent_logins(t.login_history, AS_OF, hours=48)


@query
def alert_run_history(t: Tables) -> DataFrame:
    return audit.alert_run_history(t.alert_history, AS_OF)


@query
def column_tag_check(t: Tables) -> DataFrame:
    return audit.column_tag_check(t.tag_references, "MRN")


@query
def policies_on(t: Tables) -> DataFrame:
    return audit.policies_on(t.policy_references, "PATIENT", "GOV")


@query
def grant_snapshot(t: Tables) -> DataFrame:
    return audit.grant_snapshot(t.grants_to_roles, t.grants_to_users)


# Anomalies -------------------------------------------------------------------


@query
def volume_spike(t: Tables) -> DataFrame:
    return anomaly.volume_spike(t.query_history, AS_OF)


@query
def off_hours_access(t: Tables) -> DataFrame:
    return anomaly.off_hours_access(t.query_history, t.access_history, AS_OF, "UTC")


@query
def novel_client_ip(t: Tables) -> DataFrame:
    return anomaly.novel_client_ip(t.login_history, t.grants_to_users, AS_OF)


@query
def novel_client_ip_inherited(t: Tables) -> DataFrame:
    return anomaly.novel_client_ip(
        t.login_history, t.grants_to_users, AS_OF, grants_to_roles=t.grants_to_roles
    )


@query
def volume_spike_daily(t: Tables) -> DataFrame:
    """The spikes from sums stored day by day."""
    path = session.work_path(t.spark, "volumes")
    queries = t.query_history
    history.write_history(queries, f"{path}/queries", "start_time")
    incremental.start_volumes(queries, f"{path}/days", ADDED_DAYS[0])
    for day in ADDED_DAYS:
        incremental.add_volumes(t.spark, f"{path}/queries", f"{path}/days", day)
    return incremental.volume_spike_daily(t.spark, f"{path}/queries", f"{path}/days", AS_OF)


@query
def novel_client_ip_daily(t: Tables) -> DataFrame:
    """The new addresses from first sights stored day by day."""
    path = session.work_path(t.spark, "first-seen")
    logins = t.login_history
    history.write_history(logins, f"{path}/logins", "event_timestamp")
    incremental.start_first_seen(logins, f"{path}/pairs", ADDED_DAYS[0])
    for day in ADDED_DAYS:
        incremental.add_first_seen(t.spark, f"{path}/logins", f"{path}/pairs", day)
    holders = anomaly.sensitive_role_holders(t.grants_to_users, AS_OF)
    return incremental.novel_client_ip_daily(
        t.spark, f"{path}/logins", f"{path}/pairs", holders, AS_OF
    )


@query
def mass_export(t: Tables) -> DataFrame:
    return anomaly.mass_export(t.query_history, t.access_history, AS_OF)


@query
def mass_export_orders(t: Tables) -> DataFrame:
    return anomaly.mass_export(
        t.order_queries, t.order_accesses, ORDERS_AS_OF, days=3650
    )


@query
def empty_result_probe(t: Tables) -> DataFrame:
    return anomaly.empty_result_probe(t.query_history, t.access_history, AS_OF, min_zero=1)


@query
def untagged_sensitive(t: Tables) -> DataFrame:
    return anomaly.untagged_sensitive_columns(t.classified, t.tag_references)


@query
def classify_columns(t: Tables) -> DataFrame:
    return anomaly.classify_columns(t.patient)


@query
def classify_by_profile(t: Tables) -> DataFrame:
    """Profiles of the two halves of a table, merged, as if each had come on its own day."""
    half = F.pmod(F.xxhash64("patient_id"), F.lit(2)) == 0
    halves = [profiling.profile(t.patient.filter(side)) for side in (half, ~half)]
    return profiling.classify_profiles(profiling.merged(halves))


# Usage register --------------------------------------------------------------


@query
def ai_function_calls(t: Tables) -> DataFrame:
    return usage.ai_function_calls(t.query_history, AI_NAMESPACE, AS_OF)


@query
def ml_training_calls(t: Tables) -> DataFrame:
    return usage.ml_training_calls(t.query_history, ML_NAMESPACE, AS_OF)


@query
def ai_calls_on_phi(t: Tables) -> DataFrame:
    return usage.ai_calls_on_phi(t.query_history, t.access_history, AI_NAMESPACE, AS_OF)


# Alerts ----------------------------------------------------------------------


@query
def alert_breakglass(t: Tables) -> DataFrame:
    return alerts.breakglass_events(t.login_history)


@query
def alert_policy_detach(t: Tables) -> DataFrame:
    return alerts.policy_detach_events(t.query_history)


@query
def alert_tag_unset(t: Tables) -> DataFrame:
    return alerts.tag_unset_events(t.query_history)


@query
def alert_admin_session(t: Tables) -> DataFrame:
    return alerts.admin_session_events(t.query_history)


@query
def alert_new_events(t: Tables) -> DataFrame:
    events = alerts.alert_events(t.login_history, t.query_history)
    return alerts.new_events(events, t.alert_state, AS_OF, lookback_hours=720)


@query
def alert_notifications(t: Tables) -> DataFrame:
    events = alerts.alert_events(t.login_history, t.query_history)
    return alerts.notification(events, lines_per_message=100)


@query
def alert_replay(t: Tables) -> DataFrame:
    """The ledger after the alerts were polled at each of ``POLLS``, each poll reading it anew."""
    path = session.work_path(t.spark, "alert-replay")
    # Derived once and stored by day: a poll opens the days of its look-back.
    derived = alerts.alert_events(t.login_history, t.query_history)
    history.write_history(derived, f"{path}/events", "event_timestamp")
    ledger = t.spark.createDataFrame([], alerts.LEDGER)
    for number, poll in enumerate(POLLS):
        since = dt.datetime.fromisoformat(poll) - dt.timedelta(hours=POLL_LOOKBACK_HOURS)
        events = history.read_history(
            t.spark, f"{path}/events", derived.schema, "event_timestamp", since, poll
        )
        fresh = alerts.new_events(events, ledger, poll, POLL_LOOKBACK_HOURS)
        alerts.record(fresh, f"{path}/ledger", number, poll)
        ledger = alerts.read_ledger(t.spark, f"{path}/ledger")
    return ledger.select("alert_name", "event_key", F.col("notified_at").alias("reported_at"))


@query
def alert_stream(t: Tables) -> DataFrame:
    """A backfill of several batches, in whatever order the files come."""
    spark = t.spark
    path = session.work_path(spark, "alert-stream")
    t.events.repartition(STREAM_FILES).write.parquet(f"{path}/arriving")
    arriving = read_stream(spark, f"{path}/arriving", t.events.schema, files_per_batch=2)
    streamed = Tables(spark, t.root, events=arriving)
    running = start_alert_stream(
        streamed.login_history, streamed.query_history, path, f"{path}/checkpoint", lateness=None
    )
    running.awaitTermination()
    return read_alerts(spark, path).select(
        *alerts.EVENT_COLUMNS[:-1], F.col("event_timestamp").cast("timestamp_ntz")
    )


# Protection ------------------------------------------------------------------


def _session(t: Tables, primary: str, *secondary: str) -> protect.SessionRoles:
    edges = rolegraph.role_edges(t.grants_to_roles)
    return protect.SessionRoles.resolve(t.spark, edges, primary, secondary)


def _protected(t: Tables, primary: str, *secondary: str) -> DataFrame:
    return protect.protect(
        t.patient, t.tag_references, t.row_entitlements, PATIENT_TABLE,
        _session(t, primary, *secondary),
    )


@query
def mask_patient(t: Tables) -> DataFrame:
    return protect.apply_tag_masks(
        t.patient, t.tag_references, PATIENT_TABLE, _session(t, "FR_NATION_7")
    )


@query
def row_access(t: Tables) -> DataFrame:
    return protect.row_access(
        t.patient, t.row_entitlements, _session(t, "FR_NATION_7", "FR_NATION_8")
    )


@query
def session_roles(t: Tables) -> DataFrame:
    primary = live(t.users).select(
        F.col("name").alias("session_id"), F.col("default_role").alias("role"),
        F.lit(True).alias("is_primary"),
    )
    granted = live(t.grants_to_users).select("grantee_name", "role", F.lit(False))
    return protect.session_roles(
        primary.union(granted), rolegraph.role_edges(t.grants_to_roles)
    )


@query
def protected_patient_admin(t: Tables) -> DataFrame:
    return _protected(t, "FR_PLATFORM_ADMIN")


@query
def protected_patient_clinical(t: Tables) -> DataFrame:
    return _protected(t, "FR_CLINICAL_ANALYTICS")


@query
def visibility_report(t: Tables) -> DataFrame:
    return protect.visibility_report(
        t.patient, t.row_entitlements, _all_roles(t), rolegraph.role_edges(t.grants_to_roles)
    )


# Marts -----------------------------------------------------------------------


def _transform_view(t: Tables) -> DataFrame:
    return _protected(t, "FR_DBT_TRANSFORM")


@query
def stg_patients(t: Tables) -> DataFrame:
    return marts.stg_patients(_transform_view(t))


@query
def patients_by_facility(t: Tables) -> DataFrame:
    return marts.patients_by_facility(stg_patients(t), AS_OF)


@query
def column_tests(t: Tables) -> DataFrame:
    source = marts.column_tests(
        t.patient, "patient", ["patient_id", "facility_id"], ["patient_id"]
    )
    mart = marts.column_tests(
        marts.patients_by_facility(marts.stg_patients(t.patient), AS_OF), "patients_by_facility",
        ["facility_id", "patient_count", "mart_refreshed_at"], ["facility_id"],
    )
    return source.unionByName(mart)


@query
def materialized_mart(t: Tables) -> DataFrame:
    """The mart as it is read after it was published a second time."""
    path = session.work_path(t.spark, "mart")
    masked = marts.patients_by_facility(marts.stg_patients(t.patient), AS_OF)
    marts.materialize(masked.filter("facility_id < 'F2'"), "patients_by_facility", "table", path)
    marts.materialize(masked, "patients_by_facility", "table", path)
    return read_published(t.spark, path)


# Access review ---------------------------------------------------------------


class Review:
    """Inputs and result of one monthly review."""

    def __init__(self, t: Tables):
        self.tables = t
        self.expected = review.expected_grants(t.role_matrix, t.membership, t.inventory)
        self.sensitivity = review.role_sensitivity(t.role_matrix)
        self.held = review.direct_grants(t.grants_to_users)
        self.services = review.service_logins(t.inventory)
        self.identities = review.mark_services(t.identities, self.services)

    @property
    def logins(self):
        return self.held, self.identities, self.services, REVIEW_DAY

    @property
    def actual(self) -> DataFrame:
        """Effective grants of the roles that the review may judge."""
        return rolegraph.effective_grants(
            self.tables.grants_to_users, self.tables.grants_to_roles,
            review.managed_vocabulary(self.expected),
        )

    @property
    def exceptions(self) -> DataFrame:
        return review.reconcile(
            self.actual, self.expected, self.identities, self.services, self.sensitivity,
            REVIEW_DAY, held=self.held,
        )


@query
def expected_grants(t: Tables) -> DataFrame:
    return review.expected_grants(t.role_matrix, t.membership, t.inventory)


@query
def role_sensitivity(t: Tables) -> DataFrame:
    return review.role_sensitivity(t.role_matrix)


@query
def over_provisioned(t: Tables) -> DataFrame:
    r = Review(t)
    return review.over_provisioned(r.actual, r.expected)


@query
def under_provisioned(t: Tables) -> DataFrame:
    r = Review(t)
    return review.under_provisioned(r.actual, r.expected)


@query
def unmanaged_service(t: Tables) -> DataFrame:
    return review.unmanaged_service(*Review(t).logins)


@query
def stale_keys(t: Tables) -> DataFrame:
    return review.stale_keys(*Review(t).logins)


@query
def orphans(t: Tables) -> DataFrame:
    return review.orphans(*Review(t).logins)


@query
def stale_humans(t: Tables) -> DataFrame:
    return review.stale_humans(*Review(t).logins)


@query
def review_exceptions(t: Tables) -> DataFrame:
    return Review(t).exceptions


@query
def service_accounts(t: Tables) -> DataFrame:
    return review.service_accounts(t.users)


@query
def valid_approvals(t: Tables) -> DataFrame:
    return review.valid_approvals(t.approvals, Review(t).exceptions, RUN_ID, RUNNER, REVIEW_DAY)


@query
def remediation_plan(t: Tables) -> DataFrame:
    return review.remediation_plan(
        Review(t).exceptions, t.approvals, review.direct_grants(t.grants_to_users), RUN_ID, RUNNER,
        REVIEW_DAY, max_revokes=MANY,
    )


@query
def exception_report(t: Tables) -> DataFrame:
    return review.exception_report(Review(t).exceptions)


@query
def evidence_digest(t: Tables) -> DataFrame:
    return evidence.evidence_manifest(Review(t).exceptions, RUN_ID, MATRIX_SHA)


@query
def evidence_proofs(t: Tables) -> DataFrame:
    """Each exception with a proof that the digest of the review covers it, checked."""
    rows = session.checkpointed(Review(t).exceptions)[0]
    tree = session.checkpointed(evidence.digest_tree(rows))[0]
    root = evidence.digest(rows).select("sha256")
    leaves = evidence.leaves(rows).select("exception_id", "hash")
    return evidence.proven(leaves, tree, root).crossJoin(F.broadcast(root)).select(
        "exception_id", F.col("hash").alias("row_hash"), "sha256", "proven"
    )


@query
def owner_reports(t: Tables) -> DataFrame:
    """What is read back of the owners' reports of a run."""
    path = session.work_path(t.spark, "owner-reports")
    found = Review(t).exceptions
    return sinks.publish_owner_reports(found, _teams(t), path).select(
        "owner", "exception_id", "kind", "identity", "role", "severity"
    )


@query
def review_summary(t: Tables) -> DataFrame:
    return review.review_summary(Review(t).exceptions)


# Conformance -----------------------------------------------------------------


@query
def logins_outside_allowlist(t: Tables) -> DataFrame:
    return conformance.logins_outside_allowlist(
        t.login_history, t.cidrs, t.user_policies, "NP_CORPORATE"
    )


@query
def quota_actions(t: Tables) -> DataFrame:
    return conformance.quota_actions(t.usage, QUOTAS)


@query
def idle_sessions(t: Tables) -> DataFrame:
    return conformance.idle_sessions(t.activity)


@query
def privilege_diff(t: Tables) -> DataFrame:
    legacy = conformance.grants_at(t.grants_to_roles, LEGACY_AS_OF)
    return rolegraph.privilege_diff(_all_roles(t), t.grants_to_roles, legacy)


@query
def sod_violations(t: Tables) -> DataFrame:
    return conformance.sod_violations(t.grants_to_users, t.grants_to_roles)


@query
def control_drift(t: Tables) -> DataFrame:
    return conformance.control_drift(t.policy_references, t.policy_references_now)


def _review_history(t: Tables) -> DataFrame:
    """Monthly runs; which of them report an exception follows from its id."""
    bits = F.conv(F.substring("exception_id", 1, 2), 16, 10).cast("int")
    runs = [F.when(bits.bitwiseAND(1 << at) != 0, run) for at, run in enumerate(RUNS)]
    return Review(t).exceptions.select(
        F.explode(F.array_compact(F.array(*runs))).alias("run_id"),
        "exception_id", "kind", "identity", "role", "severity",
    )


def _teams(t: Tables) -> DataFrame:
    """(identity, owner): logins by the length of their name, some of which nobody owns."""
    size = F.length("login")
    team = F.concat(F.lit("TEAM_"), (F.ascii(F.right("login", F.lit(1))) % TEAMS).cast("string"))
    return t.identities.filter(size % 7 != 0).select(F.col("login").alias("identity"), team.alias("owner")).distinct()


def _history_once(t: Tables) -> DataFrame:
    return session.checkpointed(_review_history(t))[0]


@query
def exception_aging_by_run(t: Tables) -> DataFrame:
    """The ages from a state that every run is added to, and stored with."""
    path = session.work_path(t.spark, "aging")
    runs = _history_once(t)
    state = t.spark.createDataFrame([], incremental.AGING)
    for run_id in RUNS:
        run = runs.filter(F.col("run_id") == run_id)
        state = publish(incremental.advance_aging(state, run, run_id), path)
    return state


@query
def exception_report_aged(t: Tables) -> DataFrame:
    runs = _history_once(t)
    latest = runs.filter(F.col("run_id") == RUNS[-1]).drop("run_id")
    return incremental.aged_report(latest, conformance.exception_aging(runs)).select(
        "exception_id", "kind", "severity", "identity", "role", "first_seen", "runs_seen"
    )


@query
def review_counts_by_team(t: Tables) -> DataFrame:
    return incremental.counts_by_team(_review_history(t), _teams(t))


@query
def evidence_changes(t: Tables) -> DataFrame:
    """What the last run reports that the one before didn't, and the reverse."""
    runs = _history_once(t)
    before, after = (runs.filter(F.col("run_id") == r).drop("run_id") for r in RUNS[-2:])
    return evidence.evidence_changes(before, after)


@query
def exception_aging(t: Tables) -> DataFrame:
    return conformance.exception_aging(_review_history(t))


@query
def review_counts(t: Tables) -> DataFrame:
    return conformance.review_counts(_review_history(t))


@query
def review_metrics(t: Tables) -> DataFrame:
    return conformance.review_metrics(_review_history(t), RUNS[-1])


@query
def history_digest(t: Tables) -> DataFrame:
    return history.history_digest(t.query_history, "start_time", "query_history")


@query
def export_history(t: Tables) -> DataFrame:
    """Digests of the month as it was exported and read back."""
    path = session.work_path(t.spark, "export")
    return history.export_history(t.query_history, "query_history", "start_time", EXPORT_MONTH, path)


@query
def scrub_text(t: Tables) -> DataFrame:
    return conformance.scrub_text(t.documents)


@query
def scrub_conversations(t: Tables) -> DataFrame:
    return conformance.scrub_text(t.conversations)


@query
def small_cohorts(t: Tables) -> DataFrame:
    people = t.patient.withColumn("birth_year", F.year("dob"))
    return conformance.small_cohorts(people, ["facility_id", "birth_year"], k=5)


@query
def redaction_rate(t: Tables) -> DataFrame:
    return conformance.redaction_rate(
        t.returned, "role_name", "returned_at", strings=["full_name"], dates=["dob"]
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Query):
        return lambda spark, sf_dir: build(Tables(session.tune(spark), sf_dir))

    return {name: bind(build) for name, build in REGISTRY.items()}
