"""Findings kept up day by day give what the whole past gives, and read only the new day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline import schemas
from wardline.operators import anomaly, conformance, evidence, incremental
from wardline.sources import history

DAYS = [dt.date(2024, 1, d) for d in range(1, 21)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Logins and queries of twenty days, with hot users and addresses that come back."""
    draw = random.Random(12)
    base = tmp_path_factory.mktemp("past")
    logins, queries = [], []
    for day in DAYS:
        for n in range(30):
            at = dt.datetime.combine(day, dt.time(draw.randrange(24), draw.randrange(60), draw.randrange(60)))
            user = draw.choice(["hot", "hot", "a", "b", "c"])
            ip = draw.choice([f"10.0.0.{draw.randrange(1, 8)}", f"10.0.{day.day}.1", None])
            logins.append((user, ip, at, draw.choice(["YES", "YES", "NO"]), None, None))
            queries.append((f"q{day}{n}", user, "R", at, draw.randrange(100) * (20 if draw.random() < 0.1 else 1), "x", "SELECT", "SUCCESS"))
    logins = spark.createDataFrame(logins, schemas.LOGIN_HISTORY)
    queries = spark.createDataFrame(queries, schemas.QUERY_HISTORY)
    history.write_history(logins, f"{base}/logins", "event_timestamp")
    history.write_history(queries, f"{base}/queries", "start_time")
    incremental.start_first_seen(logins, f"{base}/pairs", "2024-01-11 08:00:00")
    incremental.start_volumes(queries, f"{base}/days", "2024-01-11 08:00:00")
    # The last two days are added in the wrong order, and one of them twice.
    for day in [*DAYS[10:17], DAYS[18], DAYS[17], DAYS[18], DAYS[19]]:
        incremental.add_first_seen(spark, f"{base}/logins", f"{base}/pairs", f"{day} 12:00:00")
        incremental.add_volumes(spark, f"{base}/queries", f"{base}/days", f"{day} 12:00:00")
    return str(base), logins, queries


MOMENTS = ["2024-01-12 00:00:00", "2024-01-15 13:30:00", "2024-01-19 23:59:59", "2024-01-20 18:00:00"]


@pytest.mark.parametrize("as_of", MOMENTS)
def test_first_seen(spark, make, stored, as_of):
    base, logins, _ = stored
    grants = make(
        schemas.GRANTS_TO_USERS, *[(u, "FR_CLINICAL_ANALYTICS", "s", None, None) for u in ("hot", "a", "b")]
    )
    roles = ["FR_CLINICAL_ANALYTICS"]
    holders = anomaly.sensitive_role_holders(grants, as_of, roles)
    for recent in (1, 2.5):
        got = incremental.novel_client_ip_daily(
            spark, f"{base}/logins", f"{base}/pairs", holders, as_of, recent
        )
        want = anomaly.novel_client_ip(logins, grants, as_of, roles, recent)
        assert rows(got) == rows(want)
    assert want.count() > 0


@pytest.mark.parametrize("as_of", MOMENTS)
def test_volume_spike(spark, stored, as_of):
    base, _, queries = stored
    for deviations in (0.0, 2.0):
        got = incremental.volume_spike_daily(
            spark, f"{base}/queries", f"{base}/days", as_of, deviations=deviations
        )
        want = anomaly.volume_spike(queries, as_of, deviations=deviations)
        assert [(*r[:2], pytest.approx(r[2]), pytest.approx(r[3]), r[4]) for r in rows(want)] == rows(got)


def _days_read(df):
    return {p.split("event_date=")[1][:10] for p in df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}


def test_only_new_days_are_read(spark, stored, monkeypatch):
    base, _, _ = stored
    logins = history.read_history(
        spark, f"{base}/logins", schemas.LOGIN_HISTORY, "event_timestamp", "2024-01-15 00:00:00", "2024-01-15 23:59:59"
    )
    assert _days_read(logins) == {"2024-01-15"}
    read = []
    holders = spark.createDataFrame([("hot",)], "user_name string")

    def noting(spark, path, *args):
        df = history.read_history(spark, path, *args)
        read.append((path, _days_read(df)))
        return df

    monkeypatch.setattr(incremental, "read_history", noting)
    found = incremental.novel_client_ip_daily(spark, f"{base}/logins", f"{base}/pairs", holders, "2024-01-15 13:30:00")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "first_date#" in plan and "/logins" not in plan and "Exchange hashpartitioning(first_date" not in plan
    incremental.volume_spike_daily(spark, f"{base}/queries", f"{base}/days", "2024-01-15 13:30:00")
    assert read == [
        (f"{base}/logins", {"2024-01-14", "2024-01-15"}),
        (f"{base}/queries", {"2024-01-07"}), (f"{base}/queries", {"2024-01-15"}),
    ]


def test_aging_by_run(make):
    draw = random.Random(3)
    kinds = {f"e{n}": draw.choice(["ORPHAN", "STALE"]) for n in range(12)}
    runs = [(f"2024-0{r}", e, kinds[e]) for r in range(1, 7) for e in kinds if draw.random() < 0.5]
    whole = make("run_id string, exception_id string, kind string", *runs)
    state = make(incremental.AGING)
    for run_id in [f"2024-0{r}" for r in (1, 2, 3, 3, 4, 5, 6)]:
        state = incremental.advance_aging(state, whole.filter(F.col("run_id") == run_id), run_id)
    assert rows(state) == rows(conformance.exception_aging(whole))


def test_counts_by_team(make):
    past = make(
        "run_id string, identity string, severity string", ("r", "a", "LOW"), ("r", "a", "HIGH"), ("r", "b", "LOW"), ("s", "c", "LOW")
    )
    got = incremental.counts_by_team(past, make("identity string, owner string", ("a", "T"), ("c", "T")))
    assert rows(got) == sorted([
        ("r", None, None, "run", 3, 2), ("s", None, None, "run", 1, 1),
        ("r", "T", None, "team", 2, 1), ("r", "UNOWNED", None, "team", 1, 1), ("s", "T", None, "team", 1, 1),
        ("r", "T", "LOW", "severity", 1, 1), ("r", "T", "HIGH", "severity", 1, 1),
        ("r", "UNOWNED", "LOW", "severity", 1, 1), ("s", "T", "LOW", "severity", 1, 1),
    ], key=repr)


def test_proofs_hold_without_the_other_rows(spark, make):
    found = make("id string, n long", *[(f"e{n % 300}", n % 7) for n in range(700)], (None, None))
    root = evidence.digest(found).first().sha256
    tree = evidence.digest_tree(found)
    assert tree.filter("level = 2").first().node == root
    proven = evidence.proofs(evidence.leaves(found).distinct(), tree)
    holds = evidence.proof_holds(F.col("hash"), F.col("proof"), F.lit(root))
    assert proven.filter(holds).count() == proven.count() == found.distinct().count()
    # Nothing else can be proven: another row, another root, or a proof with one body changed.
    other = evidence.leaves(make("id string, n long", ("e1", 99))).first().hash
    assert proven.filter(evidence.proof_holds(F.lit(other), F.col("proof"), F.lit(root))).count() == 0
    assert proven.filter(evidence.proof_holds(F.col("hash"), F.col("proof"), F.lit(other))).count() == 0
    for level in range(3):
        forged = F.transform(F.col("proof"), lambda b, k: F.when(k == level, F.concat(b, F.lit(",x:1"))).otherwise(b))
        assert proven.filter(evidence.proof_holds(F.col("hash"), forged, F.lit(root))).count() == 0


def test_changes_between_runs(make):
    schema = "id string, n long"
    before = make(schema, *[(f"e{n}", n) for n in range(200)], (None, 1))
    after = make(schema, *[(f"e{n}", n + (n == 50)) for n in range(3, 203)], (None, 1))
    wanted = [(f"e{n}", n, "GONE") for n in (0, 1, 2, 50)] + [("e50", 51, "NEW")]
    wanted += [(f"e{n}", n, "NEW") for n in (200, 201, 202)]
    assert rows(evidence.evidence_changes(before, after)) == sorted(wanted, key=repr)
    assert evidence.evidence_changes(before, before).count() == 0


def test_shared_bodies_prove_what_single_proofs_do(spark, make):
    """For all rows at once, with honest and forged trees, and no row takes a root body with it."""
    found = make("id string, n long", *[(f"e{n % 300}", n % 7) for n in range(700)], (None, None))
    digest, tree, leaves = evidence.digest(found), evidence.digest_tree(found), evidence.leaves(found)
    root = digest.first().sha256

    def single(tree):
        holds = evidence.proof_holds(F.col("hash"), F.col("proof"), F.lit(root))
        return rows(evidence.proofs(leaves, tree).select("hash", holds.alias("proven")))

    got = evidence.proven(leaves, tree, digest)
    assert rows(got, "hash", "proven") == single(tree)
    assert got.count() == found.count() and got.filter("not proven").count() == 0
    assert evidence.proven(evidence.leaves(make("id string, n long", ("e1", 99))), tree, digest).first().proven is False
    nobody = make("sha256 string", ("0" * 64,))
    assert evidence.proven(leaves, tree, nobody).filter("proven").count() == 0
    for level in range(3):
        one = tree.filter(F.col("level") == level).agg(F.min("prefix")).first()[0]
        changed = (F.col("level") == level) & (F.col("prefix") == one)
        forged = tree.withColumn("body", F.when(changed, F.concat("body", F.lit(",x:1"))).otherwise(F.col("body")))
        wanted = single(forged)
        assert rows(evidence.proven(leaves, forged, digest), "hash", "proven") == wanted
        assert not all(proven for _, proven in wanted)


def test_review_makes_out_few_whole_proofs(spark, make, monkeypatch):
    """A whole proof repeats the root body: one for each entry of that body, not one a row."""
    from wardline.plans import catalog

    found = spark.range(12_000).selectExpr("concat('e', id) exception_id", "'STALE' kind", "concat('u', id) identity")
    monkeypatch.setattr(catalog, "Review", lambda t: type("Found", (), {"exceptions": found}))
    made, proofs = [], evidence.proofs
    monkeypatch.setattr(evidence, "proofs", lambda rows, *more: made.append(rows.count()) or proofs(rows, *more))
    got = catalog.evidence_proofs(None)
    assert got.count() == got.filter("proven").count() == 12_000
    assert len(made) == 1 and made[0] <= 16**3
