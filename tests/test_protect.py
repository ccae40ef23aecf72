import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline import schemas
from wardline.operators import marts, protect
from wardline.operators.rolegraph import role_edges

RED = "***REDACTED***"
TABLE = "RAW_MASKED.GOV.PATIENT"
ALPHA = ("P001", "Test Patient Alpha", "MRN-900001", dt.date(1980, 5, 5), "alpha@example.com", "FAC_A")
BRAVO = ("P002", "Test Patient Bravo", "MRN-900002", dt.date(1975, 11, 20), "bravo@example.com", "FAC_A")
CHARLIE = ("P003", "Test Patient Charlie", None, dt.date(1990, 7, 7), None, "FAC_B")
GRANTED = [
    ("FR_CLINICAL_ANALYTICS", "AR_PHI_UNMASK"), ("FR_CLINICAL_ANALYTICS", "AR_RAW_GOV_R"),
    ("FR_PLATFORM_ADMIN", "AR_RAW_GOV_R"), ("FR_DBT_TRANSFORM", "AR_RAW_GOV_R"),
    ("SYSADMIN", "FR_PLATFORM_ADMIN"), ("ACCOUNTADMIN", "SYSADMIN"), ("FR_ANALYST", "AR_MARTS_R"),
]


@pytest.fixture
def world(spark, make):
    class World:
        patient = make(schemas.PATIENT, ALPHA, BRAVO, CHARLIE)
        tags = make(
            schemas.TAG_REFERENCES,
            *[("RAW_MASKED", "GOV", "PATIENT", c, t, "x") for c, t in [
                ("FULL_NAME", "PII_STRING"), ("MRN", "PII_STRING"), ("EMAIL", "PII_STRING"),
                ("DOB", "PII_DATE"), (None, "DATA_CLASSIFICATION"),
            ]],
            ("RAW_MASKED", "GOV", "OTHER", "FACILITY_ID", "PII_STRING", "x"),
        )
        entitlements = make(schemas.ROW_ENTITLEMENTS, ("FR_CLINICAL_ANALYTICS", "FAC_A"))
        grants = make(
            schemas.GRANTS_TO_ROLES,
            *[(p, "USAGE", "ROLE", c, None, "s", None, None) for p, c in GRANTED],
            ("AR_RAW_GOV_R", "SELECT", "TABLE", TABLE, "RAW_MASKED", "s", None, None),
        )

        def session(self, primary, *secondary):
            return protect.SessionRoles.resolve(spark, role_edges(self.grants), primary, secondary)

        def read(self, primary, *secondary):
            session = self.session(primary, *secondary)
            return protect.protect(self.patient, self.tags, self.entitlements, TABLE, session)

    return World()


def masked(patient):
    return (patient[0], RED, RED, dt.date(patient[3].year, 1, 1), RED, patient[5])


def test_admin_sees_all_rows_masked(world):
    assert rows(world.read("FR_PLATFORM_ADMIN")) == [masked(ALPHA), masked(BRAVO), masked(CHARLIE)]


def test_clinical_sees_entitled_rows_clear(world):
    assert rows(world.read("FR_CLINICAL_ANALYTICS")) == [ALPHA, BRAVO]


def test_transform_counts_all_rows(world):
    staged = marts.stg_patients(world.read("FR_DBT_TRANSFORM"))
    assert staged.columns == [
        "patient_id", "patient_name", "mrn", "patient_email", "date_of_birth", "facility_id",
    ]
    mart = marts.patients_by_facility(staged, "2024-01-30 00:00:00")
    assert rows(mart, "facility_id", "patient_count") == [("FAC_A", 2), ("FAC_B", 1)]


@pytest.mark.parametrize(
    "primary, secondary, clear, visible",
    [
        ("FR_CLINICAL_ANALYTICS", (), True, 2),
        ("FR_ANALYST", ("FR_CLINICAL_ANALYTICS",), False, 2),  # rows count secondaries, masks do not
        ("ACCOUNTADMIN", (), False, 3),  # no administrator bypass
        ("FR_ANALYST", (), False, 0),
        ("fr_clinical_analytics", (), True, 2),
    ],
    ids=["primary", "secondary", "account admin", "analyst", "lower case"],
)
def test_role_activation(world, primary, secondary, clear, visible):
    session = world.session(primary, *secondary)
    assert session.primary_has_role("AR_PHI_UNMASK") is clear
    seen = world.read(primary, *secondary)
    assert seen.count() == visible
    if visible:
        assert (seen.filter(F.col("full_name") == RED).count() == 0) is clear


def test_mask_stays_below_later_steps(world):
    view = marts.stg_patients(world.read("FR_DBT_TRANSFORM"))
    assert rows(view.filter("patient_name LIKE 'Test%'")) == []
    by_day = view.groupBy("date_of_birth").count()
    assert all(r.date_of_birth.month == r.date_of_birth.day == 1 for r in by_day.collect())


def test_column_tagged_later_is_masked(world, make):
    world.tags = world.tags.union(
        make(schemas.TAG_REFERENCES, ("RAW_MASKED", "GOV", "PATIENT", "facility_id", "PII_STRING", "x"))
    )
    assert {r.facility_id for r in world.read("FR_PLATFORM_ADMIN").collect()} == {RED}


def test_tag_that_does_not_fit_is_an_error(world, make):
    world.tags = make(schemas.TAG_REFERENCES, ("RAW_MASKED", "GOV", "PATIENT", "DOB", "PII_STRING", "x"))
    with pytest.raises(TypeError):
        world.read("FR_PLATFORM_ADMIN")


def test_without_grant_the_read_is_refused(world):
    args = (world.patient, TABLE, world.grants, world.tags, world.entitlements)
    with pytest.raises(PermissionError):
        protect.guarded_read(*args, "FR_ANALYST")
    assert protect.guarded_read(*args, "FR_CLINICAL_ANALYTICS").count() == 2


def test_session_roles_of_many(world, make):
    active = make(
        "session_id string, role string, is_primary boolean",
        ("s1", "FR_ANALYST", True), ("s1", "fr_clinical_analytics", False), ("s2", "SYSADMIN", True),
    )
    got = protect.session_roles(active, role_edges(world.grants))
    assert ("s1", "AR_PHI_UNMASK", False) in rows(got)
    assert ("s2", "AR_RAW_GOV_R", True) in rows(got)
    assert len(rows(got)) == 8


def test_visibility(world, make):
    roles = make("role_name string", *[(r,) for r in ("FR_CLINICAL_ANALYTICS", "SYSADMIN", "FR_ANALYST")])
    report = protect.visibility_report(
        world.patient, world.entitlements, roles, role_edges(world.grants)
    )
    assert rows(report) == [
        ("FR_ANALYST", 0, False), ("FR_CLINICAL_ANALYTICS", 2, True), ("SYSADMIN", 3, False),
    ]


def test_column_checks(make):
    df = make("a string, b int", ("x", 1), ("x", None), (None, 2), (None, 3))
    assert marts.check_not_null(df, "a").count() == 2
    assert rows(marts.check_unique(df, "a")) == [("x", 2)]
    assert rows(marts.column_tests(df, "t", ["a", "b"], ["a", "b"])) == [
        ("t", "a", "not_null", 2), ("t", "a", "unique", 1),
        ("t", "b", "not_null", 1), ("t", "b", "unique", 0),
    ]


def test_materialize(spark, make, tmp_path):
    df = make("a string", ("x",))
    assert rows(marts.materialize(df, "stg_view")) == [("x",)]
    assert rows(marts.materialize(df, "t", "table", str(tmp_path / "t"))) == [("x",)]
    with pytest.raises(ValueError):
        marts.materialize(df, "t", "index")
