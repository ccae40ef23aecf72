import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline import schemas
from wardline.operators import anomaly, audit, profiling, usage
from wardline.operators.conformance import grants_at

NOW = "2024-01-30 12:00:00"
PHI, MART = ("RAW_MASKED.GOV.PATIENT",), ("ANALYTICS.MARTS.X",)


def q(qid, user, start, rows_produced, text="SELECT 1", role="FR_A"):
    return (qid, user, role, start, rows_produced, text, "SELECT", "SUCCESS")


def a(qid, user, start, *objects):
    return (qid, start, user, list(objects))


@pytest.fixture
def logs(make):
    def build(queries, accesses=()):
        return make(schemas.QUERY_HISTORY, *queries), make(schemas.ACCESS_HISTORY, *accesses)

    return build


def days(user, *volumes, today=None):
    made = [q(f"{user}{i}", user, f"2024-01-{22 + i + 1:02d} 13:00:00", v) for i, v in enumerate(volumes)]
    if today is not None:
        made.append(q(f"{user}t", user, "2024-01-30 01:00:00", today))
    return made


def test_volume_spike(logs):
    history, _ = logs(
        days("steady", 100, 100, 100, today=101)  # no spread: anything above the mean
        + days("wide", 0, 200, today=300)
        + days("wider", 0, 200, today=383)  # 100 + 2 * 141.42
        + days("one", 50, today=51)  # a single day has no deviation
        + days("zero", 0, 0, today=10)  # a mean of zero never counts
        + days("new", today=10**6)
        + days("SVC_X", 1, 1, today=10**6)
        + days("X_svc", 1, 1, today=10**6)
    )
    got = rows(anomaly.volume_spike(history, NOW), "user_name", "rows_today", "avg_7d_baseline")
    assert got == [("one", 51, 50.0), ("steady", 101, 100.0), ("wider", 383, 100.0)]


def test_spike_is_not_shown_to_depend_on_idle_days(logs):
    history, _ = logs([q("1", "u", "2024-01-25 00:00:00", 10), q("2", "u", "2024-01-30 00:00:00", 30)])
    (found,) = anomaly.volume_spike(history, NOW).collect()
    assert found.multiple_of_baseline == 3.0


def test_objects_of_a_query_do_not_multiply_it(logs):
    saturday = "2024-01-27 12:00:00"
    one = logs([q("1", "u", saturday, 20_000)], [a("1", "u", saturday, PHI)])
    many = logs([q("1", "u", saturday, 20_000)], [a("1", "u", saturday, PHI, PHI, MART)] * 3)
    for name, args in [("off_hours_access", ("UTC",)), ("mass_export", ()), ("empty_result_probe", ())]:
        run = getattr(anomaly, name)
        assert rows(run(*one, NOW, *args)) == rows(run(*many, NOW, *args)), name
    assert anomaly.off_hours_access(*many, NOW, "UTC").first().rows_produced == 20_000


@pytest.mark.parametrize(
    "start, zone, wanted",
    [
        ("2024-01-24 05:59:00", "UTC", (5, "Wednesday")),
        ("2024-01-24 06:00:00", "UTC", None),
        ("2024-01-24 21:59:00", "UTC", None),
        ("2024-01-24 22:00:00", "UTC", (22, "Wednesday")),
        ("2024-01-28 12:00:00", "UTC", (12, "Sunday")),
        ("2024-01-27 12:00:00", "UTC", (12, "Saturday")),
        ("2024-01-24 12:00:00", "America/Los_Angeles", (4, "Wednesday")),
        ("2024-01-24 05:00:00", "Asia/Tokyo", None),
    ],
)
def test_off_hours(logs, start, zone, wanted):
    tables = logs([q("1", "u", start, 1)], [a("1", "u", start, PHI)])
    got = rows(anomaly.off_hours_access(*tables, NOW, zone), "hour_local", "day_of_week")
    assert got == ([wanted] if wanted else [])


def test_off_hours_needs_same_time_and_object(logs):
    start, other = "2024-01-27 12:00:00", "2024-01-27 12:00:01"
    tables = logs(
        [q("1", "u", start, 1), q("2", "u", start, 1), q("3", "SVC_X", start, 1)],
        [a("1", "u", other, PHI), a("2", "u", start, MART), a("3", "SVC_X", start, PHI)],
    )
    assert rows(anomaly.off_hours_access(*tables, NOW, "UTC")) == []


def login(user, ip, ts, ok="YES"):
    return (user, ip, ts, ok, None, None)


def test_novel_ip(make):
    logins = make(
        schemas.LOGIN_HISTORY,
        login("ana", "10.0.1.5", "2024-01-02 00:00:00"),
        login("ana", "10.0.1.5", "2024-01-30 08:00:00"),
        login("ana", "10.0.2.88", "2024-01-30 09:00:00"),
        login("ana", "10.0.2.88", "2024-01-30 09:14:03"),
        login("ana", "10.0.9.9", "2024-01-05 00:00:00", "NO"),  # a failure is no history
        login("ana", "10.0.9.9", "2024-01-30 10:00:00"),
        login("ana", None, "2024-01-05 00:00:00"),
        login("ana", None, "2024-01-30 11:00:00"),  # an unknown address is always new
        login("bob", "10.9.9.9", "2024-01-30 09:00:00"),
        login("via", "10.7.7.7", "2024-01-30 09:00:00"),
    )
    grants = make(
        schemas.GRANTS_TO_USERS, ("ana", "AR_PHI_UNMASK", "s", None, None),
        ("bob", "FR_ANALYST", "s", None, None), ("via", "GRP", "s", None, None),
    )
    roles = make(
        schemas.GRANTS_TO_ROLES, ("GRP", "USAGE", "ROLE", "AR_PHI_UNMASK", None, "s", None, None)
    )
    direct = rows(anomaly.novel_client_ip(logins, grants, NOW), "user_name", "novel_ip")
    assert direct == [("ana", "10.0.2.88"), ("ana", "10.0.9.9"), ("ana", None)]
    seen = anomaly.novel_client_ip(logins, grants, NOW).filter("novel_ip = '10.0.2.88'").first()
    assert str(seen.first_seen) == "2024-01-30 09:14:03"
    wider = anomaly.novel_client_ip(logins, grants, NOW, grants_to_roles=roles)
    assert ("via", "10.7.7.7") in rows(wider, "user_name", "novel_ip")


def test_probe(logs):
    def empty(user, n, total):
        made = [(f"{user}{i}", f"2024-01-29 10:{i:02d}:00", 0 if i < n else 5) for i in range(total)]
        return ([q(i, user, s, r) for i, s, r in made], [a(i, user, s, PHI) for i, s, r in made])

    parts = [empty("golden", 15, 15), empty("few", 10, 10), empty("half", 12, 24), empty("more", 12, 23)]
    tables = logs(sum((p[0] for p in parts), []), sum((p[1] for p in parts), []))
    got = anomaly.empty_result_probe(*tables, NOW)
    assert rows(got, "user_name", "total_queries", "zero_row_queries", "pct_empty") == [
        ("golden", 15, 15, 100.0), ("more", 23, 12, 52.2),
    ]


def test_mass_export(logs):
    start = "2024-01-24 10:00:00"
    tables = logs(
        [q("1", "u", start, 10_000), q("2", "u", start, 10_001, "x" * 400), q("3", "BREAKGLASS_1", start, 99_999)],
        [a("1", "u", start, PHI), a("2", "u", start, PHI), a("3", "BREAKGLASS_1", start, PHI)],
    )
    (found,) = anomaly.mass_export(*tables, NOW).collect()
    assert (found.query_id, len(found.query_text_excerpt)) == ("2", 300)


def test_classifier(make):
    df = make(
        "contact string, notes string, patient_name string, dob date, code int",
        *[(f"u{i}@example.com", "plain text", "x", None, i) for i in range(9)],
        ("none", None, "x", None, 1),
    )
    got = rows(anomaly.classify_columns(df), "column_name", "semantic_category", "privacy_category")
    assert got == [
        ("contact", "EMAIL", "IDENTIFIER"), ("dob", "DATE_OF_BIRTH", "QUASI_IDENTIFIER"),
        ("patient_name", "NAME", "IDENTIFIER"),
    ]
    strict = anomaly.classify_columns(df.select("contact", "notes"), min_ratio=0.95)
    assert rows(strict) == []


def test_untagged(make):
    findings = make(
        "result map<string, struct<semantic_category: string, privacy_category: string>>",
        ({"EMAIL": ("EMAIL", "IDENTIFIER"), "NAME": ("NAME", "IDENTIFIER"), "CODE": ("X", None)},),
    )
    classified = anomaly.classified_from_map(findings, "RAW_MASKED", "GOV", "PATIENT")
    as_json = make("result string", ('{"EMAIL": {"semantic_category": "EMAIL"}}',))
    flat = anomaly.classified_from_map(as_json, "D", "S", "T")
    assert rows(flat) == [("D", "S", "T", "EMAIL", "EMAIL", None)]
    tags = make(
        schemas.TAG_REFERENCES, ("RAW_MASKED", "GOV", "PATIENT", "EMAIL", "PII_STRING", "x"),
        ("RAW_MASKED", "GOV", "PATIENT", "NAME", "OTHER_TAG", "x"),
    )
    got = anomaly.untagged_sensitive_columns(classified, tags)
    assert rows(got, "column_name", "signal") == [("NAME", "UNTAGGED_PHI_CANDIDATE")]


def test_usage_patterns(logs):
    start = "2024-01-24 10:00:00"
    tables = logs(
        [q("1", "u", start, 1, "select host.ai.complete('x')"), q("2", "u", start, 1, "select complete")],
        [a("1", "u", start, PHI, ("raw_masked.z",), MART)],
    )
    assert usage.ai_function_calls(tables[0], "HOST.AI", NOW).count() == 1
    assert rows(usage.ai_calls_on_phi(*tables, "HOST.AI", NOW), "accessed_object") == [
        ("RAW_MASKED.GOV.PATIENT",), ("raw_masked.z",),
    ]


def test_dormant(make):
    base = dict.fromkeys(schemas.USERS.names)

    def user(name, last, **more):
        return tuple(dict(base, name=name, disabled=False, last_success_login=last, **more).values())

    import datetime as dt

    users = make(
        schemas.USERS, user("never", None), user("old", dt.datetime(2023, 10, 1, 23, 59)),
        user("recent", dt.datetime(2024, 1, 29)), user("gone", None, deleted_on=dt.datetime(2024, 1, 1)),
    )
    got = [(r.user_name, r.days_since_login) for r in audit.dormant_users(users, NOW).collect()]
    assert got == [("never", None), ("old", 121)]


def test_service_users_without_roles(make):
    base = dict.fromkeys(schemas.USERS.names)

    def user(name, **more):
        return tuple(dict(base, name=name, **more).values())

    users = make(
        schemas.USERS, user("SVCX1"), user("a", type="SERVICE"), user("person", type="PERSON"),
        user("key", has_rsa_public_key=True, has_password=False),
    )
    grants = make(
        schemas.GRANTS_TO_USERS, ("a", "R2", "s", None, None), ("a", "R1", "s", None, None),
        ("a", "R1", "s", None, None), ("key", "R9", "s", None, NOW),
    )
    got = rows(audit.service_users(users, grants), "service_user", "roles_held")
    assert got == [("SVCX1", ""), ("a", "R1, R2"), ("key", "")]


def test_grants_at(make):
    grants = make(
        schemas.GRANTS_TO_USERS,
        ("kept", "R", "s", "2023-01-01 00:00:00", None),
        ("later gone", "R", "s", "2023-01-01 00:00:00", "2024-01-01 00:00:00"),
        ("gone", "R", "s", "2023-01-01 00:00:00", "2023-02-01 00:00:00"),
        ("new", "R", "s", "2024-01-01 00:00:00", None),
    )
    assert rows(grants_at(grants, "2023-06-01 00:00:00"), "grantee_name", "deleted_on") == [
        ("kept", None), ("later gone", None),
    ]


def test_classified_by_values_rather_than_names(make):
    n = 60
    columns = {
        "email_sent": ["Y", "N"] * (n // 2),  # a name that promises what isn't there
        "notes": [f"{i:03d}-12-{1000 + i}" for i in range(n)],  # a name that hides what is
        "mixed": [f"u{i}@x.org" if i % 3 else "none" for i in range(n)],
        "contact_email": [f"u{i}@x.org" if i % 2 else "unknown" for i in range(n)],
        "birth_place": ["New York", "Los Angeles"] * (n // 2),
        "who": [f"Ann{chr(97 + i % 26)} Lee{chr(97 + i // 26)}" for i in range(n)],
        "number": ["4111 1111 1111 1111", "3782-822463-10005", "4012888888881881"] * (n // 3),
        "order_number": ["4111111111111112"] * n,
        "admitted": ["2024-01-01"] * n, "dob": ["1980-02-03"] * n,
        "ssn": [None] * n, "empty": [" "] * n,
        "seen_from": ["2001:db8::1", "10.0.0.1"] * (n // 2),
    }
    df = make(", ".join(f"{c} string" for c in columns) + ", amount double", *[(*r, 1.5) for r in zip(*columns.values())])
    whole = profiling.profile(df)
    parts = [profiling.profile(df.filter(F.pmod(F.hash("notes"), F.lit(3)) == k)) for k in range(3)]
    wanted = {
        "notes": ("US_SSN", "VALUES"), "contact_email": ("EMAIL", "NAME_AND_VALUES"), "who": ("NAME", "VALUES"),
        "number": ("PAYMENT_CARD", "VALUES"), "dob": ("DATE_OF_BIRTH", "NAME_AND_VALUES"), "ssn": ("US_SSN", "NAME"),
        "seen_from": ("IP_ADDRESS", "VALUES"),
    }
    for made in (whole, profiling.merged(parts)):
        got = profiling.classify_profiles(made).collect()
        assert {r.column_name: (r.semantic_category, r.evidence) for r in got} == wanted
    figures = {r.column_name: r for r in profiling.described(profiling.merged(parts)).collect()}
    notes = figures["notes"]
    assert (notes.rows, notes.filled, notes.different, notes.longest) == (n, n, n, 11)
    assert notes.top_shapes[0] == "9-9-9" and figures["ssn"].filled == 0 and figures["ssn"].median is None
    assert set(figures["contact_email"].top_shapes) == {"a9@a.a", "a"}
