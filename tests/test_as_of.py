"""Rows after ``as_of`` change no report of that moment."""

import pytest

from tests.conftest import rows
from wardline import schemas
from wardline.operators import alerts, anomaly, audit, rolegraph, usage

NOW = "2024-01-30 12:00:00"
BEFORE, AFTER = "2024-01-30 03:00:00", "2024-01-30 12:00:01"
PHI = [("RAW_MASKED.GOV.PATIENT",)]


def logins(make, *times):
    return make(schemas.LOGIN_HISTORY, *[("u", f"10.0.0.{i}", t, ok, None, None)
                                         for i, t in enumerate(times) for ok in ("YES", "NO")])


def queries(make, *times):
    text = "SELECT HOST.AI.COMPLETE('m', 'p') UNSET MASKING POLICY"
    return make(schemas.QUERY_HISTORY, *[(f"q{i}", "u", "FR_A", t, 20_000, text, "ALTER", "SUCCESS")
                                         for i, t in enumerate(times)])


def accesses(make, *times):
    return make(schemas.ACCESS_HISTORY, *[(f"q{i}", t, "u", PHI) for i, t in enumerate(times)])


def holders(make):
    return make(schemas.GRANTS_TO_USERS, ("u", "AR_PHI_UNMASK", "s", "2024-01-01 00:00:00", None),
                ("v", "AR_PHI_UNMASK", "s", "2024-01-01 00:00:00", None))


def edges(make):
    return make(schemas.GRANTS_TO_ROLES)


REPORTS = {
    "failed_logins": lambda m, t: audit.failed_logins(logins(m, *t), NOW, min_failures=1),
    "recent_failed_logins": lambda m, t: audit.recent_failed_logins(logins(m, *t), NOW),
    "recent_logins": lambda m, t: audit.recent_logins(logins(m, *t), NOW, hours=12),
    "alert_run_history": lambda m, t: audit.alert_run_history(
        m(schemas.ALERT_HISTORY, *[("a", at, None, "S", None) for at in t]), NOW),
    "grant_changes": lambda m, t: audit.grant_changes(edges(m), m(
        schemas.GRANTS_TO_USERS, *[("u", "R", "s", at, None) for at in t]), NOW),
    "volume_spike": lambda m, t: anomaly.volume_spike(
        queries(m, "2024-01-29 10:00:00", *t), NOW, deviations=-1.0),
    "off_hours": lambda m, t: anomaly.off_hours_access(
        queries(m, *t), accesses(m, *t), NOW, "UTC", first_hour=23, last_hour=23),
    "mass_export": lambda m, t: anomaly.mass_export(queries(m, *t), accesses(m, *t), NOW),
    "novel_client_ip": lambda m, t: anomaly.novel_client_ip(logins(m, *t), holders(m), NOW),
    "never_read": lambda m, t: rolegraph.phi_granted_never_read(
        edges(m), holders(m), accesses(m, *t), NOW),
    "ai_calls": lambda m, t: usage.ai_function_calls(queries(m, *t), "HOST.AI", NOW),
    "ai_calls_on_phi": lambda m, t: usage.ai_calls_on_phi(
        queries(m, *t), accesses(m, *t), "HOST.AI", NOW),
    "new_events": lambda m, t: alerts.new_events(
        alerts.alert_events(logins(m, *t), queries(m, *t)), m(schemas.ALERT_STATE), NOW,
        lookback_hours=24),
}


@pytest.mark.parametrize("name", REPORTS)
def test_window_ends_at_as_of(make, name):
    then = rows(REPORTS[name](make, [BEFORE, NOW]))
    assert then and rows(REPORTS[name](make, [BEFORE, NOW, AFTER])) == then


def test_roles_dropped_later_were_live(make):
    roles = make(schemas.ROLES, ("LATER", AFTER), ("BEFORE", BEFORE), ("LIVE", None))
    got = audit.unused_roles(roles, queries(make), NOW)
    assert rows(got, "role_name") == [("LATER",), ("LIVE",)]
