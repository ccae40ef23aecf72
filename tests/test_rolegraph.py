import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline import schemas
from wardline.operators import rolegraph as rg

EDGE, ROLE = "child_role string, parent_role string", "role_name string"


def closure(seeds, edges):
    """Every (top, seed) pair by plain search."""
    pairs = set()
    for seed in set(seeds):
        todo, seen = [seed], {seed}
        while todo:
            at = todo.pop()
            for child, parent in edges:
                if child == at and parent not in seen:
                    seen.add(parent)
                    todo.append(parent)
        pairs |= {(top, seed) for top in seen}
    return sorted(pairs)


CHAIN = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(9)]
DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")]
CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")]
HUB = [(f"x{i}", "hub") for i in range(20)] + [("hub", f"y{i}") for i in range(20)]


@pytest.mark.parametrize("limit", [rg.BROADCAST_BYTES, 0], ids=["broadcast", "shuffle"])
@pytest.mark.parametrize(
    "seeds, edges",
    [(["n00", "n07"], CHAIN), (["a", "c"], DIAMOND), (["a"], CYCLE), (["x1", "x2", "lonely"], HUB)],
    ids=["chain", "diamond", "cycle", "hub"],
)
def test_closure(make, monkeypatch, seeds, edges, limit):
    monkeypatch.setattr(rg, "BROADCAST_BYTES", limit)
    seed, edge = make(ROLE, *[(s,) for s in seeds]), make(EDGE, *edges)
    wanted = closure(seeds, edges)
    assert rows(rg.role_closure(seed, edge)) == wanted
    bounds = {}
    for top, origin in wanted:
        low, high = bounds.get(top, (origin, origin))
        bounds[top] = (min(low, origin), max(high, origin))
    assert rows(rg.role_reach(seed, edge)) == sorted(
        (r, *b, r in seeds) for r, b in bounds.items()
    )


def test_random_graph(make):
    random.seed(7)
    nodes = [f"r{i}" for i in range(30)]
    edges = [tuple(random.sample(nodes, 2)) for _ in range(60)]
    seeds = random.sample(nodes, 6)
    got = rg.role_closure(make(ROLE, *[(s,) for s in seeds]), make(EDGE, *edges), hops=3)
    assert rows(got) == closure(seeds, edges)
    reach = rg.role_reach(make(ROLE, *[(s,) for s in seeds]), make(EDGE, *edges), hops=3)
    grouped = itertools.groupby(closure(seeds, edges), key=lambda pair: pair[0])
    wanted = [(top, min(s), max(s)) for top, s in ((t, [p[1] for p in g]) for t, g in grouped)]
    assert rows(reach.drop("is_seed")) == sorted(wanted)


def test_closure_grows_with_edges_and_is_stable(make):
    seed = make(ROLE, ("a",), ("a",), (None,))
    few, more = make(EDGE, *DIAMOND[:3]), make(EDGE, *DIAMOND, (None, "z"), ("e", None))
    first, second = rows(rg.role_closure(seed, few)), rows(rg.role_closure(seed, more))
    assert set(first) < set(second)
    again = rg.role_closure(seed, more).selectExpr("reachable_role AS role_name")
    assert rows(rg.role_closure(again, more)) == second


def test_no_edges(make):
    assert rows(rg.role_closure(make(ROLE, ("a",)), make(EDGE))) == [("a", "a")]


def to_role(grantee, name, kind="ROLE", privilege="USAGE", catalog=None, deleted=None):
    return (grantee, privilege, kind, name, catalog, "sec", None, deleted)


def to_user(user, role, deleted=None):
    return (user, role, "sec", None, deleted)


@pytest.fixture
def grants(make):
    gone = "2024-01-01 00:00:00"
    roles = make(
        schemas.GRANTS_TO_ROLES,
        to_role("AR_RAW", "T1", "TABLE", "SELECT", "RAW_MASKED"),
        to_role("FR_CLIN", "AR_RAW"),
        to_role("FR_CLIN", "AR_PHI_UNMASK"),
        to_role("GRP", "FR_CLIN"),
        to_role("OLD", "FR_CLIN", deleted=gone),
        to_role("FR_OTHER", "T2", "TABLE", "SELECT", "ANALYTICS"),
    )
    users = make(
        schemas.GRANTS_TO_USERS,
        to_user("scim", "GRP"), to_user("direct", "FR_CLIN"), to_user("raw", "AR_RAW"),
        to_user("ex", "GRP", gone), to_user("old", "OLD"), to_user("other", "FR_OTHER"),
        to_user("ghost", "FR_BREAKGLASS"),
    )
    return roles, users


def test_seed(grants):
    # AR_PHI_UNMASK matches by name as the granted object, so its holder is a seed too.
    assert rows(rg.phi_role_seed(grants[0])) == [("AR_RAW",), ("FR_CLIN",)]


def test_access_paths(grants):
    assert rows(rg.phi_access_report(*grants)) == [
        ("direct", "FR_CLIN", "DIRECT"),
        ("direct", "FR_CLIN", "INHERITED"),  # a seed that also inherits another seed
        ("raw", "AR_RAW", "DIRECT"),
        ("scim", "GRP", "INHERITED"),
    ]


def users_table(make, *names):
    base = dict.fromkeys(schemas.USERS.names)
    return make(
        schemas.USERS, *[tuple(dict(base, name=n, disabled=False, has_mfa=True).values()) for n in names]
    )


def test_privileged_keeps_grantees_without_user(make, grants):
    report = rg.privileged_access_report(*grants, users_table(make, "scim"))
    assert rows(report, "user_name", "privileged_role", "has_mfa") == [("ghost", "FR_BREAKGLASS", None)]


def test_entitlements_drop_grantees_without_user(make, grants):
    report = rg.phi_entitlement_extract(*grants, users_table(make, "scim"))
    assert rows(report, "user_name", "phi_role_reached", "granted_via_role") == [
        ("scim", "AR_PHI_UNMASK", "GRP")
    ]


def test_never_read(make, grants):
    access = make(
        schemas.ACCESS_HISTORY,
        ("q1", "2024-01-20 00:00:00", "scim", [("raw_masked.gov.patient",), ("X",)]),
        ("q2", "2023-01-20 00:00:00", "direct", [("RAW_MASKED.GOV.PATIENT",)]),
    )
    report = rg.phi_granted_never_read(*grants, access, "2024-01-30 00:00:00")
    assert rows(report) == [("direct", "HAS PHI ROLE, NO PHI ACCESS IN 90 DAYS")]


def test_effective_grants(make):
    roles = make(
        schemas.GRANTS_TO_ROLES, to_role("grp", "fr_a"), to_role("FR_A", "AR_X"), to_role("AR_X", "GRP")
    )
    users = make(schemas.GRANTS_TO_USERS, to_user("alice", "grp"), to_user("ALICE", "GRP"))
    assert rows(rg.effective_grants(users, roles)) == [
        ("ALICE", "AR_X"), ("ALICE", "FR_A"), ("ALICE", "GRP"),
    ]


def test_effective_privileges(make, grants):
    got = rg.effective_privileges(make(ROLE, ("GRP",), ("OLD",)), grants[0])
    assert rows(got) == [("GRP", "SELECT", "TABLE", "T1")]


def test_deep_chain_takes_few_rounds(spark, make):
    """Depth 180 in the logarithm of it: rounds of doubling, each one job."""
    edges = [(f"r{i:03d}", f"r{i + 1:03d}") for i in range(180)]
    seed, edge = make(ROLE, ("r000",), ("r100",)), make(EDGE, *edges)
    spark.sparkContext.setJobGroup("deep", "closure")
    got = rg.role_closure(seed, edge)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep"))
    spark.sparkContext.setJobGroup("tests", "")
    assert rows(got) == closure(["r000", "r100"], edges)
    assert jobs <= 12
    reach = rows(rg.role_reach(seed, edge))
    assert len(reach) == 181 and reach[-1] == ("r180", "r000", "r100", False)


def test_doubling_finds_all_paths(make):
    """Deeper than the first step, with branches of different length and a circle."""
    random.seed(11)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n30", "n5"), ("n3", "n20"), ("x", "n39"), ("n40", "y")]
    edges += [(f"n{random.randrange(41)}", f"z{i}") for i in range(10)]
    got = rg.role_closure(make(ROLE, ("n0",), ("n25",), ("x",)), make(EDGE, *edges), hops=2)
    assert rows(got) == closure(["n0", "n25", "x"], edges)


def test_set_bits(spark, make):
    bits = [0, 1, 7, 8, 63, 64, 500, 511, 512, 4095, 20_000, 32_767]
    df = spark.createDataFrame([(b,) for b in bits], "b long")
    found = df.agg(F.bitmap_construct_agg("b").alias("m")).select(rg.set_bits(F.col("m")).alias("s")).first()
    assert found.s == bits
    assert make("m binary", (bytearray(),), (None,)).select(rg.set_bits(F.col("m")).alias("s")).collect()[0].s == []


@pytest.mark.parametrize("bits", [4, rg.BITS])
def test_privileges_as_sets(make, monkeypatch, bits):
    """Against plain sets, also where privileges need several bitmaps."""
    monkeypatch.setattr(rg, "BITS", bits)
    random.seed(8)
    grants = [to_role(f"R{i + 1}", f"R{i}") for i in range(8)] + [to_role("R2", "R5")]
    own = [(f"R{random.randrange(9)}", f"T{random.randrange(30)}", random.choice(["SELECT", "INSERT"])) for _ in range(60)]
    now = grants + [to_role(r, t, "TABLE", p) for r, t, p in own[:50]] + [to_role("R0", None, "ACCOUNT", "MONITOR")]
    then = grants[:-2] + [to_role(r, t, "TABLE", p) for r, t, p in own[10:]]
    roles = [f"R{i}" for i in range(9)]

    def held(granted):
        edges = [(g[3], g[0]) for g in granted if g[2] == "ROLE"]
        found = set()
        for role in roles:
            under, todo = {role}, [role]
            while todo:
                at = todo.pop()
                for child, parent in edges:
                    if parent == at and child not in under:
                        under.add(child)
                        todo.append(child)
            found |= {(role, g[1], g[2], g[3]) for g in granted if g[2] != "ROLE" and g[0] in under}
        return found

    names = make(ROLE, *[(r,) for r in roles])
    tables = [make(schemas.GRANTS_TO_ROLES, *g) for g in (now, then)]
    for table, granted in zip(tables, (now, then)):
        assert rows(rg.effective_privileges(names, table)) == sorted(held(granted), key=repr)
    new, old = held(now), held(then)
    wanted = [(*p, "GAINED") for p in new - old] + [(*p, "LOST") for p in old - new]
    assert rows(rg.privilege_diff(names, *tables)) == sorted(wanted, key=repr)
    one = next(iter(new))
    asked = make(ROLE, (one[0],), ("NOBODY",))
    assert rg.holds_privilege(asked, tables[0], "T1", "SELECT") == (
        any(p[0] == one[0] and p[1] == "SELECT" and p[3] == "T1" for p in new)
    )


def test_a_step_beyond_the_first_hops_keeps_to_the_seeds(spark, make, monkeypatch):
    """What lies above no seed is not followed: the long chain without one stays out of every round."""
    chain = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(12)]
    other = [(f"b{i:03d}", f"b{i + 1:03d}") for i in range(100)]
    kept, cut = [], rg.checkpointed

    def counted(df, **measures):
        found = cut(df, **measures)
        kept.append(found[0].filter("more IS NOT NULL").count() if "more" in df.columns else 0)
        return found

    monkeypatch.setattr(rg, "checkpointed", counted)
    got = rg.role_closure(make(ROLE, ("a00",)), make(EDGE, *chain, *other), hops=2)
    assert rows(got) == closure(["a00"], chain)
    assert sum(kept) == 10  # a03 to a12, each once
    reach = rows(rg.role_reach(make(ROLE, ("a00",), ("a05",)), make(EDGE, *chain, *other), hops=2))
    assert [r[:3] for r in reach if r[0] >= "a05"] == [(f"a{i:02d}", "a00", "a05") for i in range(5, 13)]


def test_few_privileges_take_few_words(make):
    """A set is as large as what is in it: one bigint for 64 privileges held together."""
    many = [to_role("MANY", f"T{i:03d}", "TABLE", "SELECT") for i in range(128)]
    few = [to_role(f"R{i}", f"U{i}", "TABLE", "SELECT") for i in range(5)]
    table = make(schemas.GRANTS_TO_ROLES, *many, *few, to_role("TOP", "MANY"), to_role("TOP", "R0"))
    names = make(ROLE, ("TOP",), ("MANY",), *[(f"R{i}",) for i in range(5)])
    sets = rg.PrivilegeSets(table)
    words = {role: (n, size) for role, n, size in rows(
        sets.of(names, table).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.bit_count("bits")).alias("size"))
    )}
    assert sum(n for n, _ in words.values()) <= 20
    assert words["TOP"][1] == 129 and words["MANY"][1] == 128 and words["R3"] == (1, 1)
    assert sets.of(names, table).schema["bits"].dataType.simpleString() == "bigint"
