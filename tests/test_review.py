import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline import schemas
from wardline.constants import PROTECTED_ROLES
from wardline.functions import exception_id, quote_ident
from wardline.operators import review

MATRIX = [
    (0, "grp-analysts", ["FR_ANALYST"], "internal"),
    (1, "grp-clinical", ["FR_CLINICAL_ANALYTICS"], "phi"),
]
INVENTORY = [("SVC_DBT", ["FR_DBT_TRANSFORM"]), ("SVC_POWERBI", ["FR_BI_REPORTING"])]
MEMBERS = [("grp-analysts", "alice"), ("grp-analysts", "bob"), ("grp-clinical", "charlie")]
JUNE, JULY = dt.date(2024, 6, 1), dt.date(2024, 7, 1)


@pytest.fixture
def expected(make):
    def build(matrix=MATRIX, members=MEMBERS, inventory=INVENTORY):
        return review.expected_grants(
            make(schemas.ROLE_MATRIX, *matrix),
            make(schemas.MEMBERSHIP, *members),
            make(schemas.SERVICE_INVENTORY, *inventory),
        )

    return build


def person(login, entra="oid-x", enabled=True, last_login=None):
    return (login, False, entra, enabled, last_login, None)


def service(login, key=None):
    return (login, True, "oid-x", True, None, key)


@pytest.fixture
def reconcile(make):
    def run(actual=(), expected=(), identities=(), services=(), sensitivity=(), managed=None, today=JUNE, **more):
        found = review.reconcile(
            make(schemas.GRANTS, *actual),
            make(schemas.GRANTS, *expected),
            make(schemas.IDENTITIES, *identities),
            make("login string", *[(s,) for s in services]),
            make("role string, sensitivity string", *sensitivity),
            today,
            vocabulary=None if managed is None else make("role string", *[(r,) for r in managed]),
            **more,
        )
        return [r.asDict() for r in found.collect()]

    return run


def kinds(found):
    return sorted(e["kind"] for e in found)


def only(found, kind):
    return [e for e in found if e["kind"] == kind]


class TestExpected:
    def test_members_and_services(self, expected):
        assert rows(expected()) == [
            ("ALICE", "FR_ANALYST"),
            ("BOB", "FR_ANALYST"),
            ("CHARLIE", "FR_CLINICAL_ANALYTICS"),
            ("SVC_DBT", "FR_DBT_TRANSFORM"),
            ("SVC_POWERBI", "FR_BI_REPORTING"),
        ]

    def test_upper_case(self, expected):
        got = expected([(0, "g", ["fr_x"], None)], [("g", "alice_lowercase")], [("svc", ["fr_y"])])
        assert rows(got) == [("ALICE_LOWERCASE", "FR_X"), ("SVC", "FR_Y")]

    def test_empty(self, expected, make):
        assert rows(expected([], [], [])) == []
        assert rows(review.role_sensitivity(make(schemas.ROLE_MATRIX))) == []

    def test_group_without_members_grants_nothing(self, expected):
        assert rows(expected(members=[], inventory=[])) == []

    def test_sensitivity_last_entry_wins(self, make):
        matrix = make(
            schemas.ROLE_MATRIX, (0, "a", ["r"], "phi"), (1, "b", ["R"], None), (2, "c", ["s"], "phi")
        )
        assert rows(review.role_sensitivity(matrix)) == [("R", "internal"), ("S", "phi")]

    def test_vocabulary(self, make, expected):
        matrix = make(schemas.ROLE_MATRIX, (0, "empty", ["FR_EMPTY"], None), *MATRIX)
        inventory = make(schemas.SERVICE_INVENTORY, *INVENTORY)
        from_grants = rows(review.managed_vocabulary(expected(members=MEMBERS[:1])))
        assert from_grants == [("FR_ANALYST",), ("FR_BI_REPORTING",), ("FR_DBT_TRANSFORM",)]
        wider = rows(review.managed_vocabulary(expected(), matrix, inventory))
        assert ("FR_EMPTY",) in wider and len(wider) == 5


class TestOverProvisioned:
    def test_extra_role(self, reconcile):
        found = reconcile(
            [("ALICE", "FR_ANALYST"), ("ALICE", "FR_CLINICAL_ANALYTICS")],
            [("ALICE", "FR_ANALYST")],
            [person("ALICE")],
        )
        assert [(e["kind"], e["role"]) for e in found] == [
            ("OVER_PROVISIONED", "FR_CLINICAL_ANALYTICS")
        ]

    def test_statements(self, reconcile):
        (over,) = reconcile([("ALICE", "FR_ANALYST")], [], [person("ALICE")])
        assert over["revoke_sql"] == 'REVOKE ROLE "FR_ANALYST" FROM USER "ALICE";'
        assert over["rollback_sql"] == 'GRANT ROLE "FR_ANALYST" TO USER "ALICE";'

    def test_inherited_roles_outside_vocabulary(self, reconcile):
        found = reconcile(
            [
                ("CHARLIE", "GROUP-CLINICAL"),
                ("CHARLIE", "FR_CLINICAL_ANALYTICS"),
                ("CHARLIE", "AR_PHI_UNMASK"),
                ("CHARLIE", "AR_MARTS_R"),
            ],
            [("CHARLIE", "FR_CLINICAL_ANALYTICS")],
            [person("CHARLIE")],
            managed=["FR_CLINICAL_ANALYTICS", "FR_ANALYST"],
        )
        assert found == []

    def test_extra_role_inside_vocabulary(self, reconcile):
        found = reconcile(
            [("ALICE", "FR_ANALYST"), ("ALICE", "FR_CLINICAL_ANALYTICS")],
            [("ALICE", "FR_ANALYST")],
            [person("ALICE")],
            managed=["FR_ANALYST", "FR_CLINICAL_ANALYTICS"],
        )
        assert [e["role"] for e in found] == ["FR_CLINICAL_ANALYTICS"]

    def test_phi_is_critical(self, reconcile):
        (over,) = reconcile(
            [("ALICE", "FR_CLINICAL_ANALYTICS")], [], [person("ALICE")],
            sensitivity=[("FR_CLINICAL_ANALYTICS", "phi")],
        )
        assert (over["severity"], over["sensitivity"]) == ("CRITICAL", "phi")

    def test_protected_roles_are_critical(self, reconcile):
        found = reconcile([("ALICE", r) for r in PROTECTED_ROLES], [], [person("ALICE")])
        assert len(found) == len(PROTECTED_ROLES) == 10
        assert {e["severity"] for e in found} == {"CRITICAL"}

    def test_plain_role_is_high(self, reconcile):
        (over,) = reconcile([("ALICE", "FR_ANALYST")], [], [person("ALICE")])
        assert (over["severity"], over["sensitivity"]) == ("HIGH", "unknown")

    def test_repeated_grants_count_once(self, reconcile):
        grants = [("ALICE", "FR_ANALYST")] * 5
        assert len(reconcile(grants, [], [person("ALICE")])) == 1


class TestUnderProvisioned:
    def test_missing_role(self, reconcile):
        (under,) = reconcile([], [("ALICE", "FR_ANALYST")], [person("ALICE")])
        assert (under["kind"], under["identity"], under["severity"]) == (
            "UNDER_PROVISIONED", "ALICE", "LOW",
        )
        assert under["revoke_sql"] is None and under["rollback_sql"] is None

    def test_role_outside_vocabulary_counts_as_missing(self, reconcile):
        found = reconcile([("A", "R")], [("A", "R")], [person("A")], managed=["OTHER"])
        assert kinds(found) == ["UNDER_PROVISIONED"]


GRANT = [("X", "FR_ANALYST")]


class TestLogins:
    @pytest.mark.parametrize(
        "identity", [person("X", entra=None), person("X", enabled=False)], ids=["no id", "disabled"]
    )
    def test_orphan(self, reconcile, identity):
        (found,) = reconcile(GRANT, GRANT, [identity])
        assert (found["kind"], found["severity"]) == ("ORPHAN", "CRITICAL")

    def test_orphan_is_not_also_stale(self, reconcile):
        found = reconcile(GRANT, GRANT, [person("X", entra=None, last_login=dt.date(2020, 1, 1))])
        assert kinds(found) == ["ORPHAN"]

    @pytest.mark.parametrize(
        "days, expected", [(100, ["STALE"]), (91, ["STALE"]), (90, []), (10, []), (None, [])]
    )
    def test_stale(self, reconcile, days, expected):
        last = None if days is None else JUNE - dt.timedelta(days=days)
        found = reconcile(GRANT, GRANT, [person("X", last_login=last)])
        assert kinds(found) == expected

    def test_unknown_login(self, reconcile):
        found = reconcile([("MYSTERY_BOT", "FR_ANALYST")])
        assert kinds(found) == ["OVER_PROVISIONED", "UNMANAGED_SVC"]

    def test_listed_service(self, reconcile):
        grants = [("SVC_DBT", "FR_DBT_TRANSFORM")]
        assert reconcile(grants, grants, [service("SVC_DBT")], ["SVC_DBT"]) == []

    def test_service_only_in_identities_is_managed(self, reconcile):
        assert reconcile(GRANT, GRANT, [service("X")]) == []

    def test_service_only_in_inventory_has_no_checks(self, reconcile):
        assert reconcile(GRANT, GRANT, [], ["X"]) == []

    def test_login_checks_ignore_vocabulary(self, reconcile):
        found = reconcile([("BOT", "AR_X")], managed=["FR_ANALYST"])
        assert kinds(found) == ["UNMANAGED_SVC"]

    @pytest.mark.parametrize(
        "days, expected", [(400, ["STALE_KEY"]), (366, ["STALE_KEY"]), (365, []), (90, []), (None, [])]
    )
    def test_key_age(self, reconcile, days, expected):
        key = None if days is None else JULY - dt.timedelta(days=days)
        found = reconcile(GRANT, GRANT, [service("X", key)], ["X"], today=JULY)
        assert kinds(found) == expected
        assert all(e["severity"] == "HIGH" for e in found)

    def test_details(self, reconcile):
        (found,) = reconcile(GRANT, GRANT, [service("X", JULY - dt.timedelta(days=400))], today=JULY)
        assert found["detail"] == "Signing key is 400 days old: set on 2023-05-28."
        (found,) = reconcile(GRANT, GRANT, [person("X", last_login=dt.date(2024, 1, 1))])
        assert found["detail"] == "Last seen on 2024-01-01; the limit is 90 days."

    def test_mark_services(self, make):
        marked = review.mark_services(
            make(schemas.IDENTITIES, person("SVC"), person("P")), make("login string", ("SVC",))
        )
        assert rows(marked, "login", "is_service") == [("P", False), ("SVC", True)]

    def test_service_accounts(self, make):
        base = dict.fromkeys(schemas.USERS.names)
        users = [
            dict(base, name="svc_a", type="SERVICE", disabled=False,
                 rsa_public_key_last_set_on=dt.datetime(2024, 1, 2, 3)),
            dict(base, name="svc_b", type="SERVICE", disabled=False),
            dict(base, name="off", type="SERVICE", disabled=True),
            dict(base, name="p", type="PERSON", disabled=False),
            dict(base, name="gone", type="SERVICE", disabled=False, deleted_on=dt.datetime(2024, 1, 1)),
        ]
        df = make(schemas.USERS, *[tuple(u.values()) for u in users])
        got = rows(review.service_accounts(df), "login", "key_last_set")
        assert got == [("SVC_A", dt.date(2024, 1, 2)), ("SVC_B", None)]


BASE = {
    "approver": "manager", "run_id": "2024-06", "identity": "ALICE", "role": "FR_ANALYST",
    "action": "REVOKE", "expires": "2099-12-31",
}


def exc(spark, kind, identity, role):
    return spark.range(1).select(
        exception_id(F.lit(kind), F.lit(identity), F.lit(role).cast("string"))
    ).first()[0]


def over(spark, identity, role, severity="HIGH"):
    return (
        exc(spark, "OVER_PROVISIONED", identity, role), "OVER_PROVISIONED", identity, role, severity,
        "internal", "test", f'REVOKE ROLE "{role}" FROM USER "{identity}";',
        f'GRANT ROLE "{role}" TO USER "{identity}";',
    )


def approval(spark, identity, role, **changes):
    body = {**BASE, "identity": identity, "role": role, **changes}
    return (exc(spark, "OVER_PROVISIONED", identity, role), *body.values())


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({}, None),
        ({"approver": "ci-bot"}, "SEPARATION_OF_DUTIES"),
        ({"approver": "CI-BOT"}, "SEPARATION_OF_DUTIES"),
        ({"run_id": "2024-05"}, "WRONG_RUN"),
        ({"run_id": None}, "WRONG_RUN"),
        ({"identity": "BOB"}, "GRANT_MISMATCH"),
        ({"role": "FR_DBT_TRANSFORM"}, "GRANT_MISMATCH"),
        ({"identity": "alice", "role": "fr_analyst"}, None),
        ({"action": "GRANT"}, "WRONG_ACTION"),
        ({"action": None}, None),
        ({"expires": "2020-01-01"}, "EXPIRED"),
        ({"expires": "2024-06-01"}, None),
        ({"expires": None}, None),
        ({"approver": None}, None),
    ],
)
def test_approval(spark, make, changes, reason):
    body = {**BASE, **changes}
    row = (exc(spark, "OVER_PROVISIONED", "ALICE", "FR_ANALYST"), *body.values())
    checked = review.valid_approvals(
        make(schemas.APPROVALS, row), make(schemas.EXCEPTIONS, over(spark, "ALICE", "FR_ANALYST")),
        "2024-06", "ci-bot", JUNE,
    )
    assert rows(checked, "valid", "reason") == [(reason is None, reason)]


@pytest.mark.parametrize(
    "name, quoted",
    [
        ("FR_ANALYST", '"FR_ANALYST"'),
        ("jdoe@example.com", '"jdoe@example.com"'),
        ('role"embedded"', '"role""embedded"""'),
        ("", '""'),
        ("SELECT", '"SELECT"'),
        ("AR_PHI/UNMASK", '"AR_PHI/UNMASK"'),
    ],
)
def test_quote(spark, name, quoted):
    assert spark.range(1).select(quote_ident(F.lit(name))).first()[0] == quoted


def test_exception_id_without_role(spark):
    import hashlib

    wanted = hashlib.sha256(b"ORPHAN|DAVE|").hexdigest()[:16]
    assert exc(spark, "ORPHAN", "DAVE", None) == wanted


class TestRemediation:
    def plan(self, make, exceptions, approvals, live, cap=10):
        return review.remediation_plan(
            make(schemas.EXCEPTIONS, *exceptions), make(schemas.APPROVALS, *approvals),
            make(schemas.GRANTS, *live), "2024-06", "ci-bot", JUNE, cap,
        )

    def test_approved_revoke(self, spark, make):
        got = self.plan(
            make, [over(spark, "A", "FR_X"), over(spark, "B", "FR_X")],
            [approval(spark, "A", "FR_X")], [("A", "FR_X"), ("B", "FR_X")],
        )
        assert rows(got, "identity", "role", "rollback_sql") == [
            ("A", "FR_X", 'GRANT ROLE "FR_X" TO USER "A";')
        ]

    def test_cap_comes_before_validity(self, spark, make):
        names = ["USER_A", "USER_B", "USER_C"]
        exceptions = [over(spark, n, "FR_ANALYST") for n in names]
        approvals = [approval(spark, n, "FR_ANALYST", approver="ci-bot") for n in names]
        with pytest.raises(review.BlastRadiusExceeded):
            self.plan(make, exceptions, approvals, [], cap=2)
        assert rows(self.plan(make, exceptions, approvals, [], cap=3)) == []

    @pytest.mark.parametrize("role", ["ACCOUNTADMIN", "SECURITYADMIN", "AR_PHI_UNMASK"])
    def test_protected_role(self, spark, make, role):
        got = self.plan(make, [over(spark, "A", role)], [approval(spark, "A", role)], [("A", role)])
        assert rows(got) == []

    def test_critical_is_manual(self, spark, make):
        got = self.plan(
            make, [over(spark, "A", "FR_X", "CRITICAL")], [approval(spark, "A", "FR_X")],
            [("A", "FR_X")],
        )
        assert rows(got) == []

    def test_grant_already_gone(self, spark, make):
        got = self.plan(make, [over(spark, "A", "FR_X")], [approval(spark, "A", "FR_X")], [])
        assert rows(got) == []

    def test_last_approval_wins(self, spark, make):
        first, last = approval(spark, "A", "R", expires="2000-01-01"), approval(spark, "A", "R")
        both = make(
            "exception_id string, approver string, run_id string, identity string, role string, "
            "action string, expires string, pos long",
            (*first, 0), (*last, 1),
        )
        assert rows(review.latest_approvals(both), "expires") == [("2099-12-31",)]


def test_report_and_summary(spark, make):
    df = make(
        schemas.EXCEPTIONS,
        *[over(spark, n, "R", s) for n, s in [("A", "LOW"), ("B", "CRITICAL"), ("C", "HIGH")]],
    )
    assert [r.severity for r in review.exception_report(df).collect()] == ["CRITICAL", "HIGH", "LOW"]
    assert tuple(review.review_summary(df).first()) == (3, 1, 2)
    assert tuple(review.review_summary(df.filter("severity = 'LOW'")).first()) == (1, 0, 0)


def test_run_review(spark, make, tmp_path):
    from wardline.plans.access_review import run_review
    from wardline.sources.tables import read_approvals, read_inventory, read_role_matrix

    matrix, inventory, approvals = (tmp_path / n for n in ("m.yaml", "i.json", "a.json"))
    matrix.write_text(
        "entra_groups:\n- entra_group_id: g\n  fr_roles: [FR_A]\n  data_sensitivity: internal\n"
        "- entra_group_id: h\n  fr_roles: [FR_B]\n"
    )
    inventory.write_text(json.dumps({"service_accounts": [{"login_name": "svc", "expected_roles": ["FR_S"]}]}))
    approvals.write_text(json.dumps([dict(zip(schemas.APPROVALS.names, approval(spark, "ALICE", "FR_B")))]))
    code = run_review(
        make(
            schemas.GRANTS_TO_USERS, ("alice", "FR_A", "x", None, None), ("alice", "FR_B", "x", None, None),
            ("svc", "GRP", "x", None, None),
        ),
        make(schemas.GRANTS_TO_ROLES, ("GRP", "USAGE", "ROLE", "FR_S", None, "x", None, None)),
        make(schemas.IDENTITIES, person("ALICE"), person("SVC")),
        make(schemas.MEMBERSHIP, ("g", "alice"), ("h", "bob")),
        read_role_matrix(spark, str(matrix)), read_inventory(spark, str(inventory)),
        str(tmp_path), "2024-06", JUNE, "sha", approvals=read_approvals(spark, str(approvals)),
    )
    assert code == 0
    report = spark.read.csv(str(tmp_path / "exception_report_2024-06"), header=True)
    assert rows(report, "kind", "identity", "role") == [
        ("OVER_PROVISIONED", "ALICE", "FR_B"), ("UNDER_PROVISIONED", "BOB", "FR_B"),
    ]
    assert rows(spark.read.text(str(tmp_path / "rollback_2024-06"))) == [
        ('GRANT ROLE "FR_B" TO USER "ALICE";',)
    ]
    manifest = spark.read.json(str(tmp_path / "audit_manifest"))
    assert rows(manifest, "exception_count", "role_matrix_commit") == [(2, "sha")]
    body = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "audit_evidence")).collect()]
    assert len(body) == 2 and all(list(b) == sorted(b) for b in body)
