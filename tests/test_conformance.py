import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline import schemas
from wardline.functions import lookup_join, measured_bytes, network, salted_join
from wardline.functions.network import ip_number
from wardline.operators import conformance as cf
from wardline.operators import evidence
from wardline.sources import history, sinks
from wardline.sources.tables import conform, read_table


@pytest.mark.parametrize(
    "ip, number",
    [("0.0.0.0", 0), ("255.255.255.255", 2**32 - 1), ("10.0.1.5", 167772421), ("256.1.1.1", None),
     ("1.2.3", None), ("1.2.3.4.5", None), ("a.b.c.d", None), ("", None), (None, None), ("::1", None)],
)
def test_ip_number(make, ip, number):
    assert make("ip string", (ip,)).select(ip_number(F.col("ip"))).first()[0] == number


def test_allowlist(make):
    random.seed(3)
    cidrs = [("CORP", "10.0.0.0/8"), ("CORP", "192.168.4.7"), ("CORP", "172.16.0.5/30"), ("CI", "10.1.2.0/24"),
             ("CI", "0.0.0.0/31"), ("CI", "300.0.0.0/8")]
    own = {"svc": "CI"}
    pool = ["10.1.2.3", "10.9.9.9", "192.168.4.7", "192.168.4.8", "172.16.0.6", "172.16.0.8", "0.0.0.1",
            "11.0.0.1", "bad", None]
    logins = [(random.choice(["svc", "ana"]), ip, "2024-01-01 00:00:00", "YES", None, None)
              for ip in pool for _ in range(3)]

    def allowed(user, ip):
        nets = [c for p, c in cidrs[:-1] if p == own.get(user, "CORP")]
        try:
            return any(ipaddress.ip_address(ip) in ipaddress.ip_network(n, strict=False) for n in nets)
        except ValueError:
            return False

    got = cf.logins_outside_allowlist(
        make(schemas.LOGIN_HISTORY, *logins), make("policy_name string, cidr string", *cidrs),
        make("user_name string, policy_name string", *own.items()), "CORP",
    )
    wanted = sorted(((u, ip) for u, ip, *_ in logins if not allowed(u, ip)), key=repr)
    assert rows(got, "user_name", "client_ip") == wanted


def test_idle_sessions(make):
    random.seed(5)
    limits = {"STANDARD": 30, "PRIVILEGED": 15}
    start, made, wanted = dt.datetime(2024, 1, 1), [], []
    for user, kind in [("a", "STANDARD"), ("b", "PRIVILEGED"), ("c", "STANDARD")]:
        at, session = start, None
        for _ in range(120):
            at += dt.timedelta(minutes=random.choice([0, 1, 5, 14, 15, 16, 29, 30, 31, 90]),
                               seconds=random.choice([0, 0, 1]))
            made.append((user, kind, at))
            if session is None or at - session[1] > dt.timedelta(minutes=limits[kind]):
                session = [at, at, 0]
                wanted.append((user, session))
            session[1], session[2] = at, session[2] + 1
    random.shuffle(made)
    got = cf.idle_sessions(make("user_name string, session_class string, ts timestamp_ntz", *made))
    assert rows(got, "user_name", "session_start", "session_end", "events") == sorted(
        ((u, *s) for u, s in wanted), key=repr
    )


def test_quota(make):
    usage = make(
        "workload string, metered_at timestamp_ntz, credits double",
        ("TRANSFORM", "2024-01-01 00:10:00", 100.0), ("TRANSFORM", "2024-01-01 00:50:00", 60.0),
        ("TRANSFORM", "2024-01-02 05:00:00", 40.0), ("TRANSFORM", "2024-01-03 05:00:00", 20.0),
        ("TRANSFORM", "2024-02-01 00:00:00", 150.0),
        ("BI", "2024-01-05 00:00:00", 300.0), ("OTHER", "2024-01-05 00:00:00", 1e6),
    )
    got = rows(cf.quota_actions(usage), "workload", "step_pct", "action", "reached_at", "credits_used")
    at = dt.datetime
    assert got == [
        ("BI", 100, "SUSPEND", at(2024, 1, 5), 300.0), ("BI", 80, "NOTIFY", at(2024, 1, 5), 300.0),
        ("TRANSFORM", 100, "SUSPEND", at(2024, 1, 2, 5), 200.0),
        ("TRANSFORM", 110, "SUSPEND_IMMEDIATE", at(2024, 1, 3, 5), 220.0),
        ("TRANSFORM", 80, "NOTIFY", at(2024, 1, 1, 0), 160.0),
    ]


def test_review_metrics(make):
    runs = {"a": ["2024-01"], "b": ["2024-01", "2024-02", "2024-04"], "c": ["2024-03", "2024-04"]}
    made = make(
        "run_id string, exception_id string, kind string, severity string",
        *[(r, e, "STALE", "MEDIUM") for e, rs in runs.items() for r in rs * 2],
    )
    (got,) = cf.review_metrics(made, "2024-04", sla_days=31).collect()
    # a: 31 days; b: 60 days, then open again; c: open
    assert (got.episodes, got.open_episodes, got.mean_days_to_remediate, got.share_in_sla) == (
        4, 2, 45.5, 0.5,
    )
    aging = rows(cf.exception_aging(made), "exception_id", "first_seen", "last_seen", "runs_seen")
    assert aging[1] == ("b", "2024-01", "2024-04", 3)


def test_sod(make):
    roles = make(
        schemas.GRANTS_TO_ROLES,
        *[(p, "USAGE", "ROLE", c, None, "s", None, None) for p, c in [
            ("FR_C", "AR_PHI_UNMASK"), ("FR_G", "AR_GOV_ADMIN"), ("SYSADMIN", "FR_G")]],
    )
    users = make(
        schemas.GRANTS_TO_USERS,
        *[(u, r, "s", None, None) for u, r in [("x", "FR_C"), ("x", "FR_G"), ("y", "FR_C"), ("z", "SYSADMIN")]],
    )
    assert rows(cf.sod_violations(users, roles)) == [
        ("ADMIN_REACHES", "SYSADMIN", "AR_GOV_ADMIN"),
        ("USER_REACHES_BOTH", "x", "AR_PHI_UNMASK+AR_GOV_ADMIN"),
    ]


def test_scrub(make):
    df = make(
        "id int, text string",
        (1, "mail a.b@mail1.example.com from 10.0.0.1 or +1 (743) 555-3824"),
        (2, 'token = "24be64439e3e49cf"; api_key:abc123 and 4785380592391139'),
        (3, "MRN-900001 has 123-45-6789"), (4, "nothing here"), (5, None),
    )
    got = rows(cf.scrub_text(df), "id", "text", "scrubbed")
    assert got == [
        (1, "mail [EMAIL] from [IP] or [PHONE]", True),
        (2, "[SECRET]; [SECRET] and [NUMBER]", True),
        (3, "[MRN] has [SSN]", True), (4, "nothing here", False), (5, None, False),
    ]


def test_digest_depends_on_rows_only(spark, make):
    df = spark.range(5000).select(
        (F.col("id") % 700).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("v")
    )
    hot = df.union(spark.range(9000).select(F.lit(1).cast("long"), F.lit("same")))
    one = evidence.digest(hot).first()
    again = evidence.digest(hot.repartition(13, "v").select("v", "k")).first()
    assert one == again and one.row_count == 14000
    changed = hot.withColumn("v", F.when(F.col("v") == "4999", "x").otherwise(F.col("v")))
    assert evidence.digest(changed).first().sha256 != one.sha256
    fewer = hot.union(hot.limit(1))
    assert evidence.digest(fewer).first().sha256 != one.sha256
    grouped = {r.k: r.sha256 for r in evidence.digest(hot, by=["k"]).collect()}
    assert len(grouped) == 700
    part = evidence.digest(hot.filter("k = 5"), columns=["v"]).first()
    assert part.sha256 == grouped[5]


def test_null_differs_from_empty(make):
    a, b = make("x string, y string", (None, "")), make("x string, y string", ("", None))
    assert evidence.digest(a).first() != evidence.digest(b).first()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    facts = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97).alias("k"),
        (F.col("id") % 5).alias("v"),
    )
    lookup = spark.range(0, 97, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    lookup = lookup.union(lookup.limit(3))
    assert rows(salted_join(facts, lookup, ["k"], how)) == rows(facts.join(lookup, "k", how))


def test_salted_join_refuses_other_joins(spark):
    with pytest.raises(ValueError):
        salted_join(spark.range(1), spark.range(1), ["id"], "full")


def test_history_reads_only_its_days(spark, make, tmp_path):
    made = [(f"q{i}", f"2024-01-{1 + i % 20:02d} 10:00:00", "u", [("A.B.C",)]) for i in range(200)]
    path = str(tmp_path / "h")
    history.write_history(make(schemas.ACCESS_HISTORY, *made), path, "query_start_time")
    df = history.read_history(
        spark, path, schemas.ACCESS_HISTORY, "query_start_time", "2024-01-18 10:00:00", "2024-01-19 23:00:00"
    )
    assert df.count() == 20 and df.columns == schemas.ACCESS_HISTORY.names
    assert len({f for f in df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]
                if "event_date=2024-01-1" not in f}) == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_export_history(spark, make, tmp_path):
    made = [(f"q{i}", f"2024-0{1 + i % 2}-03 10:00:00", "u", [("A.B.C",)]) for i in range(20)]
    flat = make(schemas.ACCESS_HISTORY, *made).drop("base_objects_accessed")
    digests = history.export_history(flat, "access_history", "query_start_time", "2024-02", str(tmp_path))
    assert rows(digests, "history", "event_date", "row_count") == [
        ("access_history", dt.date(2024, 2, 3), 10)
    ]
    direct = history.history_digest(flat, "query_start_time", "access_history")
    assert direct.filter("event_date = '2024-02-03'").first().sha256 == digests.first().sha256


def test_tables_are_checked(spark, make, tmp_path):
    make(schemas.ROLES, ("R", None)).write.parquet(str(tmp_path / "roles"))
    assert rows(read_table(spark, str(tmp_path), "roles"), "name") == [("R",)]
    with pytest.raises(ValueError, match="deleted_on"):
        conform(make("name string", ("R",)), schemas.ROLES)
    with pytest.raises(ValueError, match="not string"):
        conform(make("name int, deleted_on timestamp_ntz", (1, None)), schemas.ROLES)


def test_objects_as_json(spark, make, tmp_path):
    text = '[{"objectName": "A.B.C", "columns": [1]}, {"objectName": "D"}]'
    raw = make(
        "query_id string, query_start_time timestamp_ntz, user_name string, base_objects_accessed string",
        ("q", "2024-01-01 00:00:00", "u", text),
    )
    variant = raw.withColumn("base_objects_accessed", F.parse_json("base_objects_accessed"))
    for at, df in enumerate([raw, variant]):
        df.write.parquet(str(tmp_path / str(at) / "access_history"))
        read = read_table(spark, str(tmp_path / str(at)), "access_history")
        assert [o.objectName for o in read.first().base_objects_accessed] == ["A.B.C", "D"]


def test_lookup_beyond_the_limit(spark):
    facts, lookup = spark.range(100).selectExpr("id % 3 AS k", "id"), spark.range(2).selectExpr("id AS k")
    for how in ("inner", "left_semi", "left_anti"):
        small, large = (lookup_join(facts, lookup, ["k"], how, limit=n) for n in (1000, 1))
        assert rows(small) == rows(large)


def test_lookups_are_measured_in_bytes(make):
    short, long = (make("k string, v long", (text, 1), (None, None)) for text in ("x", "x" * 5000))
    assert measured_bytes(long) - measured_bytes(short) == 4999


def test_digest_tells_close_rows_apart(make):
    """A null from the text that once stood for it, and a separator moved by one value."""
    schema = "x string, y string"
    pairs = [(None, "a"), ("\\N", "a"), ("-", "a"), ("", "a"), ("p\x1fq", "r"), ("p", "q\x1fr"),
             ("1:a", ""), ("", "1:a"), ("a1:b", "c"), ("a", "b1:c")]
    digests = {evidence.digest(make(schema, pair)).first().sha256 for pair in pairs}
    assert len(digests) == len(pairs)


def test_owner_reports(spark, make, tmp_path):
    rows_in = [(str(i), "STALE", f"u{i % 3}", None, "LOW", "x", "d", None, None) for i in range(9)]
    owners = make("identity string, owner string", ("u0", "ann"), ("u1", "bob"))
    sinks.write_owner_reports(make(schemas.EXCEPTIONS, *rows_in), owners, str(tmp_path / "o"))
    ann = spark.read.parquet(str(tmp_path / "o" / "owner=ann"))
    assert rows(ann, "identity") == [("u0",)] * 3
    assert {p.name for p in (tmp_path / "o").glob("owner=*")} == {"owner=ann", "owner=bob", "owner=UNOWNED"}


def test_small_cohorts_and_redaction(make):
    people = make("f string, y int", *[("A", 1980)] * 5, *[("A", 1981)] * 4, ("B", None))
    assert rows(cf.small_cohorts(people, ["f", "y"], 5)) == [("A", 1981, 4), ("B", None, 1)]
    results = make(
        "role string, at timestamp_ntz, name string, dob date",
        ("C", "2024-01-01 10:00:00", "***REDACTED***", dt.date(1980, 1, 1)),
        ("C", "2024-01-01 11:00:00", "Ann", dt.date(1980, 5, 1)), ("C", "2024-01-02 11:00:00", None, None),
    )
    got = rows(cf.redaction_rate(results, "role", "at", ["name"], ["dob"]))
    assert got == [("C", dt.date(2024, 1, 1), 2, 2, 0.5), ("C", dt.date(2024, 1, 2), 1, 0, 0.0)]


def test_control_drift(make):
    row = ("MP", "MASKING_POLICY", "D", "S", "T")
    before = make(schemas.POLICY_REFERENCES, (*row, "A"), (*row, "B"))
    after = make(schemas.POLICY_REFERENCES, (*row, "A"), ("MP", "OTHER", "D", "S", "T", "B"))
    assert rows(cf.control_drift(before, after), "ref_column_name") == [("B",)]


def test_privilege_diff(make):
    schema = "role string, privilege string"
    new, old = make(schema, ("R", "A"), ("R", "A"), ("R", "B")), make(schema, ("R", "B"), ("R", "C"))
    assert rows(cf.privilege_diff(new, old)) == [("R", "A", "GAINED"), ("R", "C", "LOST")]


def test_scrub_takes_whole_tokens(make):
    texts = ["m" * 90 + "@mail.example.org x", "7" * 25, "a" * 1_000_000, "a@b@c.com"]
    df = make("text string", *[(t,) for t in texts])
    got = [r["text"] for r in cf.scrub_text(df).collect()]
    assert got == ["[EMAIL] x", "[NUMBER]", texts[2], "a@[EMAIL]"]


def test_unlisted_session_class_gets_the_strictest_limit(make):
    df = make(
        "user_name string, session_class string, ts timestamp_ntz",
        ("A", "OTHER", "2024-01-01 00:00:00"), ("A", "OTHER", "2024-01-01 00:15:00"),
        ("A", "OTHER", "2024-01-09 00:00:00"),
    )
    assert sorted(r["events"] for r in cf.idle_sessions(df).collect()) == [1, 2]


def test_drift_with_null_keys(make):
    schema = (
        "policy_name string, policy_kind string, ref_database_name string, ref_schema_name string, "
        "ref_entity_name string, ref_column_name string"
    )
    row = ("P", "MASKING_POLICY", "D", None, "T", "C")
    same = make(schema, row)
    assert cf.control_drift(same, same).count() == 0
    assert cf.control_drift(same, same.limit(0)).count() == 1


def test_scrub_finds_what_it_must(make):
    """Inputs that pattern after pattern used to leave in clear."""
    cases = {
        "user=josé@example.com": "user=[EMAIL]", "to björn.müller@example.de now": "to [EMAIL] now",
        "password='my pass word' x": "[SECRET] x", 'PASSWORD = "two words"!': "[SECRET]!",
        "api key: abc123secret": "[SECRET]", "Bearer abcdEFGH1234567890": "[SECRET]",
        "from 2001:db8::8a2e:370:7334 in": "from [IP] in", "fe80:0:0:0:1:2:3:4": "[IP]", "::1 up": "[IP] up",
        "::ffff:10.1.2.3": "[IP]", "at 12:30:45": "at 12:30:45", "std::vector": "std::vector",
        "MRN: 556677": "[MRN]", "mrn 12345": "[MRN]", "4111 1111 1111 1111": "[CARD]",
        "3782-822463-10005": "[CARD]", "4111 1111 1111 1112": "4111 1111 1111 1112",
        "ssn 123 45 6789": "[SSN]", "+44 20 7946 0958": "[PHONE]", "+1 (743) 555-3824": "[PHONE]",
        "token=a.b@c.org rest": "[SECRET] rest", "1 + 1 = 2": "1 + 1 = 2", "": "",
        "a@b.co, 10.0.0.1; 123456789012": "[EMAIL], [IP]; [NUMBER]",
    }
    df = make("n int, text string", *list(enumerate(cases)))
    got = {r["n"]: (r["text"], r["scrubbed"]) for r in cf.scrub_text(df).collect()}
    wanted = {n: (clean, clean != text) for n, (text, clean) in enumerate(cases.items())}
    assert {list(cases)[n]: got[n] for n in got} == {list(cases)[n]: wanted[n] for n in wanted}


def test_check_digit(make):
    numbers = {"4111111111111111": True, "4111111111111112": False, "378282246310005": True, "79927398713": True, "0": True}
    df = make("d string", *[(n,) for n in numbers])
    assert {r["d"]: r["ok"] for r in df.select("d", cf.check_digit_holds(F.col("d")).alias("ok")).collect()} == numbers


ADDRESSES = [
    "10.0.0.1", "10.255.255.255", "11.0.0.0", "192.168.4.7", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "2001:db9::",
    "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "::ffff:10.1.1.1", "::ffff:12.1.1.1", "fe80::1%eth0", "::", "1::", "bad",
    "1.2.3", "1:2:3:4:5:6:7:8:9", "fe80::1::2", None, "2001:db8:8::7", "2001:db8:7::7", "8.8.8.8",
]


def _parsed(ip):
    try:
        found = ipaddress.ip_address((ip or "").split("%")[0])
    except ValueError:
        return None
    return getattr(found, "ipv4_mapped", None) or found


def test_address_keys_sort_like_addresses(make):
    random.seed(6)
    made = ADDRESSES + [str(ipaddress.ip_address(random.getrandbits(128))) for _ in range(200)]
    made += [str(ipaddress.ip_address(random.getrandbits(32))) for _ in range(200)]
    df = make("ip string", *[(ip,) for ip in made])
    for r in df.select("ip", network.address_key(F.col("ip")).alias("key")).collect():
        found = _parsed(r.ip)
        digits = {4: "08x", 6: "032x"}
        assert r.key == (None if found is None else f"{found.version}{int(found):{digits[found.version]}}"), r.ip


@pytest.mark.parametrize("limit", [cf.ALLOWLIST_BYTES, 0], ids=["searched", "shuffled"])
def test_allowlist_of_both_families(make, monkeypatch, limit):
    monkeypatch.setattr(cf, "ALLOWLIST_BYTES", limit)
    random.seed(4)
    cidrs = [("P", "10.0.0.0/8"), ("P", "10.1.0.0/16"), ("P", "2001:db8::/32"), ("P", "2001:db8:8::/45"), ("P", "::1"),
             ("Q", "192.168.4.7"), ("Q", "::ffff:12.0.0.0/104"), ("Q", "fe80::/10"), ("Q", "x/8"), ("Q", "10.0.0.0/40"),
             ("Q", "10.0.0.0/x"), ("Z", "::/0"), ("Z", "0.0.0.0/0"), ("Z2", "0.0.0.0/1"), (None, "8.8.8.8")]
    for n in range(200):
        cidrs.append((f"R{n % 3}", f"{ipaddress.ip_address(random.getrandbits(32))}/{random.randrange(6, 33)}"))
        cidrs.append((f"R{n % 3}", f"{ipaddress.ip_address(random.getrandbits(128))}/{random.randrange(3, 129)}"))
    pool = ADDRESSES + [str(ipaddress.ip_address(random.getrandbits(b))) for b in (32, 128) for _ in range(60)]
    policies = ["P", "Q", "Z", "Z2", "R0", "R1", "R2"]
    logins = [(p.lower(), ip, "2024-01-01 00:00:00", "YES", None, None) for p in policies for ip in pool]
    nets = {}
    for policy, text in cidrs:
        try:
            net = ipaddress.ip_network(text, strict=False)
            if net.version == 6 and net.prefixlen >= 96 and net.network_address.ipv4_mapped:
                net = ipaddress.ip_network(f"{net.network_address.ipv4_mapped}/{net.prefixlen - 96}")
            nets.setdefault(policy, []).append(net)
        except ValueError:
            pass
    wanted = [(u, ip) for u, ip, *_ in logins if not any(
        (a := _parsed(ip)) is not None and a.version == n.version and a in n for n in nets.get(u.upper(), [])
    )]
    # A second policy of a user doesn't double logins: the first by name holds.
    own = [(p.lower(), p) for p in policies] + [("p", "Z")]
    got = cf.logins_outside_allowlist(
        make(schemas.LOGIN_HISTORY, *logins), make("policy_name string, cidr string", *cidrs),
        make("user_name string, policy_name string", *own), "DEFAULT",
    )
    assert rows(got, "user_name", "client_ip") == sorted(wanted, key=repr)


def test_logins_stay_where_they_are(make, spark, tmp_path):
    path = str(tmp_path / "logins")
    make(schemas.LOGIN_HISTORY, ("u", "10.0.0.1", "2024-01-01 00:00:00", "YES", None, None)).write.parquet(path)
    got = cf.logins_outside_allowlist(
        spark.read.schema(schemas.LOGIN_HISTORY).parquet(path), make("policy_name string, cidr string", ("P", "10.0.0.0/8")),
        make("user_name string, policy_name string", ("u", "P")), "P",
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "SortMergeJoin" not in plan
    scan = plan[: plan.index("Scan parquet")]
    assert "Exchange hashpartitioning" not in scan.split("BroadcastExchange")[0]


def test_disjoint_intervals(make):
    got = network.disjoint(make("policy_name string, low string, high string", ("P", "a", "c"), ("P", "b", "b"),
                                ("P", "c", "e"), ("P", "g", "h"), ("Q", "a", "z"), ("P", "a", "c")))
    assert rows(got) == [("P", "a", "e"), ("P", "g", "h"), ("Q", "a", "z")]
