"""Role graph: who reaches which role, and through what.

A grant of role ``name`` to role ``grantee_name`` lets the grantee inherit
``name``. The audit reports climb from a role to its holders; the access review
walks the other way, from a role a user holds to the roles it inherits.

Role graphs are closed first and joined to users last, so the steps below only ever
carry roles. One step follows ``HOPS`` grants from the seeds, which is as deep as most
graphs are. Where it doesn't reach the end, leaps of 4, 8, 16 and so on grants are followed
from what was found, and so it takes as many rounds as the logarithm of the depth. Lineage
is cut by a reliable checkpoint in each, so a lost executor costs one round. A round that
finds nothing new ends the loop, which makes cycles harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.constants import (
    ADMIN_ROLES,
    PHI_CATALOG,
    PHI_ENTITLEMENT_SEED,
    PHI_NEVER_READ_SEED,
    PHI_OBJECT_PATTERN,
    PHI_ROLE_PATTERN,
)
from wardline.functions import live, lookup_join, reads_object, row_bytes, within
from wardline.session import FEW_ROWS, checkpointed, few_tasks

HOPS = 6
# Role graphs of up to this many bytes are sent to every task; larger ones
# are joined by shuffle.
BROADCAST_BYTES = 32_000_000


def role_edges(grants_to_roles: DataFrame) -> DataFrame:
    """Live role-to-role grants as (child_role, parent_role)."""
    return (
        live(grants_to_roles)
        .filter((F.col("granted_on") == "ROLE") & (F.col("privilege") == "USAGE"))
        .select(F.col("name").alias("child_role"), F.col("grantee_name").alias("parent_role"))
    )


def phi_role_seed(
    grants_to_roles: DataFrame, catalog: str = PHI_CATALOG, pattern: str = PHI_ROLE_PATTERN
) -> DataFrame:
    """Roles with any live privilege on sensitive objects."""
    sensitive = (F.col("table_catalog") == catalog) | F.col("name").ilike(pattern)
    return (
        live(grants_to_roles)
        .filter(sensitive)
        .select(F.col("grantee_name").alias("role_name"))
        .distinct()
    )


def literal_roles(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(name,) for name in names], "role_name string")


def _rows() -> Column:
    return F.count(F.lit(1))


class _Edges:
    """Distinct usable edges, written once, with their number.

    Of a graph too large to be followed in a few tasks, the edges are broadcast as long as
    they fit.
    """

    def __init__(self, edges: DataFrame):
        usable = edges.filter(
            F.col("child_role").isNotNull()
            & F.col("parent_role").isNotNull()
            & (F.col("child_role") != F.col("parent_role"))
        )
        usable = usable.select("child_role", "parent_role").distinct()
        self.rows, found = checkpointed(usable, n=_rows(), size=F.sum(row_bytes(usable)))
        self.count, size = found["n"], found["size"] or 0
        fits = self.count > FEW_ROWS and size <= BROADCAST_BYTES
        self.joined = F.broadcast(self.rows) if fits else self.rows

    def climb(
        self, found: DataFrame, hops: int,
        grow: Callable[[DataFrame, DataFrame], DataFrame], merge: Callable[[list[DataFrame]], DataFrame],
    ) -> DataFrame:
        """``found``, what lies up to ``hops`` grants above the seeds, and all further up.

        A round follows leaps (low, high), of as many grants as the largest power of two that
        leaves no gap, and joins them with themselves for the next. Only what is above a seed
        is kept, so a round costs as much as the edges and the rows found, not as all pairs.
        ``grow`` gives the rows that ``found`` lacks, ``merge`` puts rounds together. When a
        round finds nothing, nothing is one grant further either.
        """
        leap = 1
        leaps = self.rows.select(F.col("child_role").alias("low"), F.col("parent_role").alias("high"))
        while leap * 2 <= hops + 1:
            leap, leaps = leap * 2, _twice(leaps)
        spark, total, rounds = self.rows.sparkSession, self.count, [found]
        while True:
            more = grow(found, leaps)
            # One job for both: the rows found, and the leaps of the next round.
            step = more.select(F.struct(*more.columns).alias("more"), F.lit(None).alias("leap")).unionByName(
                _twice(leaps).select(F.lit(None).alias("more"), F.struct("low", "high").alias("leap"))
            )
            with few_tasks(spark, total):
                step, seen = checkpointed(step, n=F.count("more"), leaps=F.count("leap"))
            if not seen["n"]:
                return found
            total = max(total, seen["leaps"]) + seen["n"]
            rounds.append(step.filter("more IS NOT NULL").select("more.*"))
            found = merge(rounds)
            leaps = step.filter("leap IS NOT NULL").select("leap.*")


def _twice(leaps: DataFrame) -> DataFrame:
    then = leaps.select(F.col("low").alias("middle"), F.col("high").alias("top"))
    longer = leaps.join(then, F.col("high") == F.col("middle")).filter("low <> top")
    return longer.select("low", F.col("top").alias("high")).distinct()


def role_closure(seed: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(top_role, reachable_role): every role that holds a seed role, however far up.

    Each seed is paired with itself. Pairs are distinct.
    """
    pair = ["top_role", "reachable_role"]
    graph, hops = _Edges(edges), hops or HOPS
    seeds = seed.select(F.col("role_name").alias("top_role")).filter("top_role IS NOT NULL")
    seeds = seeds.distinct().withColumn("reachable_role", F.col("top_role"))
    reached, step = [seeds.withColumn("hop", F.lit(0))], seeds
    for hop in range(1, hops + 1):
        step = (
            step.join(graph.joined, F.col("top_role") == F.col("child_role"))
            .select(F.col("parent_role").alias("top_role"), "reachable_role")
            .distinct()
        )
        reached.append(step.withColumn("hop", F.lit(hop)))
    met = reduce(DataFrame.union, reached).groupBy(*pair).agg(F.min("hop").alias("hop"))
    with few_tasks(seeds.sparkSession, graph.count):
        met, last = checkpointed(met, open=F.count_if(F.col("hop") == hops))
    if not last["open"]:
        return met.select(*pair)
    def grow(found: DataFrame, leaps: DataFrame) -> DataFrame:
        above = found.join(leaps, F.col("top_role") == F.col("low"))
        return above.select(F.col("high").alias("top_role"), "reachable_role").distinct().join(found, pair, "left_anti")

    return graph.climb(met.select(*pair), hops, grow, lambda rounds: reduce(DataFrame.union, rounds))


def role_reach(seed: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(role, low_seed, high_seed, is_seed): one row per role that holds any seed role.

    The smallest and the largest seed a role reaches are enough to tell whether
    it reaches one besides itself, and unlike the full pairs they stay one row
    per role however many seeds there are.
    """
    role = F.col("role_name")
    graph, hops = _Edges(edges), hops or HOPS
    seeds = seed.filter(role.isNotNull()).select(
        role.alias("role"), role.alias("low_seed"), role.alias("high_seed"), F.lit(True).alias("is_seed")
    )
    seeds = seeds.distinct()
    bounds = [F.min("low_seed").alias("low_seed"), F.max("high_seed").alias("high_seed")]
    reached, step = [seeds.withColumn("hop", F.lit(0))], seeds
    for hop in range(1, hops + 1):
        step = (
            step.join(graph.joined, F.col("role") == F.col("child_role"))
            .groupBy(F.col("parent_role").alias("role"))
            .agg(*bounds, F.lit(False).alias("is_seed"))
        )
        reached.append(step.withColumn("hop", F.lit(hop)))
    merged = (
        reduce(DataFrame.union, reached)
        .groupBy("role")
        .agg(
            F.min(F.struct("low_seed", "hop")).alias("low"),
            F.max(F.struct("high_seed", (-F.col("hop")).alias("minus_hop"))).alias("high"),
            F.bool_or("is_seed").alias("is_seed"),
        )
    )
    # Only what the last hop was the first to find can lead any further.
    further = F.count_if((F.col("low.hop") == hops) | (F.col("high.minus_hop") == -hops))
    with few_tasks(seeds.sparkSession, graph.count):
        merged, last = checkpointed(merged, open=further)
    if not last["open"]:
        return merged.select("role", "low.low_seed", "high.high_seed", "is_seed")
    columns = ["role", "low_seed", "high_seed", "is_seed"]

    def grow(found: DataFrame, leaps: DataFrame) -> DataFrame:
        above = found.join(leaps, F.col("role") == F.col("low")).groupBy(F.col("high").alias("role")).agg(*bounds)
        had = found.select("role", F.col("low_seed").alias("low_had"), F.col("high_seed").alias("high_had"))
        changes = "low_had IS NULL OR low_seed < low_had OR high_seed > high_had"
        return above.join(had, "role", "left").filter(changes).select(
            "role", "low_seed", "high_seed", F.lit(False).alias("is_seed")
        )

    def merge(rounds: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.union, rounds)
        return rows.groupBy("role").agg(*bounds, F.bool_or("is_seed").alias("is_seed")).select(*columns)

    return graph.climb(merged.select("role", "low.low_seed", "high.high_seed", "is_seed"), hops, grow, merge)


def _user_grants(grants_to_users: DataFrame) -> DataFrame:
    return live(grants_to_users).select(F.col("grantee_name").alias("user_name"), "role")


def _access_paths(reach: DataFrame) -> DataFrame:
    """(role, access_path): a seed itself is DIRECT; holding another seed is INHERITED.

    A role that is a seed and also holds another one gets both rows.
    """
    inherits = (F.col("low_seed") != F.col("role")) | (F.col("high_seed") != F.col("role"))
    paths = F.array_compact(
        F.array(
            F.when(F.col("is_seed"), F.lit("DIRECT")), F.when(inherits, F.lit("INHERITED"))
        )
    )
    return reach.select("role", F.explode(paths).alias("access_path"))


def _reached_paths(seed: DataFrame, edges: DataFrame) -> DataFrame:
    return _access_paths(role_reach(seed, edges))


def phi_access_report(
    grants_to_roles: DataFrame,
    grants_to_users: DataFrame,
    catalog: str = PHI_CATALOG,
    pattern: str = PHI_ROLE_PATTERN,
) -> DataFrame:
    """Users who can reach a sensitive role, and whether directly or by inheritance."""
    paths = _reached_paths(
        phi_role_seed(grants_to_roles, catalog, pattern), role_edges(grants_to_roles)
    )
    return (
        lookup_join(_user_grants(grants_to_users), paths, ["role"])
        .select("user_name", F.col("role").alias("effective_role"), "access_path")
        .distinct()
        .orderBy(F.asc_nulls_last("user_name"), F.asc_nulls_last("effective_role"))
    )


def privileged_access_report(
    grants_to_roles: DataFrame,
    grants_to_users: DataFrame,
    users: DataFrame,
    admin_roles: Iterable[str] = ADMIN_ROLES,
) -> DataFrame:
    """Holders of administrative roles with their account state.

    Grantees without a live user row are kept.
    """
    seed = literal_roles(grants_to_roles.sparkSession, admin_roles)
    paths = _reached_paths(seed, role_edges(grants_to_roles))
    accounts = live(users).select(
        F.col("name").alias("user_name"), "disabled", "has_mfa", "last_success_login"
    )
    return (
        lookup_join(_user_grants(grants_to_users), paths, ["role"])
        .select("user_name", F.col("role").alias("privileged_role"), "access_path")
        .distinct()
        .join(accounts, "user_name", "left")
        .distinct()
        .orderBy(F.asc_nulls_last("privileged_role"), F.asc_nulls_last("user_name"))
    )


def phi_entitlement_extract(
    grants_to_roles: DataFrame,
    grants_to_users: DataFrame,
    users: DataFrame,
    seeds: Iterable[str] = PHI_ENTITLEMENT_SEED,
) -> DataFrame:
    """Each live user, the sensitive role reached and the held role it comes through."""
    seed = literal_roles(grants_to_roles.sparkSession, seeds)
    closure = role_closure(seed, role_edges(grants_to_roles)).select(
        F.col("top_role").alias("role"), F.col("reachable_role").alias("phi_role_reached")
    )
    accounts = live(users).select(
        F.col("name").alias("user_name"), "disabled", "last_success_login"
    )
    return (
        lookup_join(_user_grants(grants_to_users), closure, ["role"])
        .select("user_name", "phi_role_reached", F.col("role").alias("granted_via_role"))
        .distinct()
        .join(accounts, "user_name")
        .distinct()
        .orderBy(F.asc_nulls_last("phi_role_reached"), F.asc_nulls_last("user_name"))
    )


def phi_granted_never_read(
    grants_to_roles: DataFrame,
    grants_to_users: DataFrame,
    access_history: DataFrame,
    as_of,
    days: int = 90,
    seeds: Iterable[str] = PHI_NEVER_READ_SEED,
    pattern: str = PHI_OBJECT_PATTERN,
) -> DataFrame:
    """Members of a sensitive role who read no sensitive object in the window."""
    seed = literal_roles(grants_to_roles.sparkSession, seeds)
    reach = role_reach(seed, role_edges(grants_to_roles)).select("role")
    members = (
        lookup_join(_user_grants(grants_to_users), reach, ["role"], "left_semi")
        .select("user_name")
        .distinct()
    )
    window = within(access_history, "query_start_time", as_of, days=days)
    readers = (
        access_history.filter(window & reads_object(pattern))
        .select("user_name")
        .distinct()
    )
    return (
        members.join(readers, "user_name", "left_anti")
        .withColumn("finding", F.lit(f"HAS PHI ROLE, NO PHI ACCESS IN {days} DAYS"))
        .orderBy(F.asc_nulls_last("user_name"))
    )


def _inherited_roles(roles: DataFrame, edges: DataFrame) -> DataFrame:
    """(held_role, effective_role) for each role in ``roles`` and all it inherits."""
    downward = edges.select(
        F.upper("parent_role").alias("child_role"), F.upper("child_role").alias("parent_role")
    )
    return role_closure(roles, downward).select(
        F.col("reachable_role").alias("held_role"), F.col("top_role").alias("effective_role")
    )


def _holding_roles(roles: DataFrame, edges: DataFrame) -> DataFrame:
    """(held_role, effective_role) for each role in ``roles`` and all that hold it."""
    upward = edges.select(F.upper("child_role").alias("child_role"), F.upper("parent_role").alias("parent_role"))
    return role_closure(roles, upward).select(
        F.col("top_role").alias("held_role"), F.col("reachable_role").alias("effective_role")
    )


def effective_grants(
    grants_to_users: DataFrame, grants_to_roles: DataFrame, only: DataFrame | None = None
) -> DataFrame:
    """(identity, role): every role a user holds or inherits, in upper case.

    The roles in use are closed once, not once per user. Where ``only`` some roles are asked
    for, the closure climbs from these to their holders. Both sides of the last join may be large, so a
    role held by many is left to the skew-join split, which repeats only that role's
    rows.
    """
    held = (
        live(grants_to_users)
        .select(F.upper("grantee_name").alias("identity"), F.upper("role").alias("held_role"))
        .distinct()
    )
    edges = role_edges(grants_to_roles)
    if only is None:
        inherited = _inherited_roles(held.select(F.col("held_role").alias("role_name")).distinct(), edges)
    else:
        inherited = _holding_roles(only.select(F.col("role").alias("role_name")), edges)
    return (
        held.join(inherited, "held_role")
        .select("identity", F.col("effective_role").alias("role"))
        .distinct()
    )


PRIVILEGE = ["privilege", "granted_on", "name"]
#: Privileges of one word; their bits make a bigint.
BITS = 64


class PrivilegeSets:
    """The privileges of roles as words of bits over numbered privileges.

    Privileges are numbered in the order of the first role that was granted them, over
    sorted ranges, so that no task sees all of them and those that are held together share
    words. A role's own set is one bigint for each word it has anything in, and what it
    inherits is the OR of the words of the roles it holds. Few privileges take few words and
    many take one for ``BITS`` of them. No row is made for an inherited privilege: single
    privileges are told again only for the rows asked for.
    """

    def __init__(self, *grants: DataFrame):
        objects = reduce(DataFrame.union, [_object_privileges(g) for g in grants])
        named = objects.groupBy(*PRIVILEGE).agg(F.min("effective_role").alias("first"))
        ordered = named.repartitionByRange("first", *PRIVILEGE).sortWithinPartitions("first", *PRIVILEGE)
        # Every range begins a word: its numbers start at a multiple of 2 ** 33.
        numbered = ordered.select(*PRIVILEGE, F.monotonically_increasing_id().alias("number"))
        self.names, _ = checkpointed(
            numbered.select(
                *PRIVILEGE, F.expr(f"number DIV {BITS}").alias("word"),
                (F.col("number") % BITS).cast("int").alias("place"),
            ),
            n=_rows(),
        )

    def own(self, grants: DataFrame) -> DataFrame:
        """(effective_role, word, bits): what each role was granted itself."""
        objects, names = _object_privileges(grants).alias("o"), self.names.alias("n")
        same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in PRIVILEGE])
        bit = F.expr("shiftleft(1L, place)")
        return objects.join(names, same).groupBy("effective_role", "word").agg(F.bit_or(bit).alias("bits"))

    def of(self, roles: DataFrame, grants: DataFrame) -> DataFrame:
        """(role, word, bits): what each of ``roles`` holds or inherits.

        Closed from the roles that were granted anything up to their holders.
        """
        own, _ = checkpointed(self.own(grants), n=_rows())
        granted = own.select(F.col("effective_role").alias("role_name")).distinct()
        asked = roles.select(F.col("role_name").alias("held_role")).distinct()
        closure = _holding_roles(granted, role_edges(grants)).join(asked, "held_role", "left_semi")
        return (
            closure.join(own, "effective_role")
            .groupBy(F.col("held_role").alias("role"), "word")
            .agg(F.bit_or("bits").alias("bits"))
        )

    def told(self, sets: DataFrame) -> DataFrame:
        """``sets`` without word and bits, but with (privilege, granted_on, name) of every bit set.

        The words come with the names of all their places, so only a word of a role is joined.
        """
        one = F.struct("place", *PRIVILEGE)
        words = self.names.groupBy("word").agg(F.collect_list(one).alias("names"))
        # By as many tasks as shuffles have: a word is small, but makes many rows.
        sets = sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
        set_here = F.filter("names", lambda named: F.getbit("bits", named["place"]) == 1)
        # Outer, as no set is empty, and the plan need not look whether this one is.
        each = sets.join(words, "word").withColumn("one", F.explode_outer(set_here))
        return each.drop("word", "bits", "names").select("*", *[F.col(f"one.{c}") for c in PRIVILEGE]).drop("one")


def set_bits(bits: Column) -> Column:
    """The numbers (bigint) of the bits that are set in a bitmap, from bytes that aren't zero."""
    digits = F.hex(bits)
    count = (F.length(digits) / 2).cast("int")
    # Blocks of 64 bytes first: most of a bitmap is empty.
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((count - 1) / 64).cast("int"), F.lit(0)))
    empty = F.lit("0" * 128)
    used = F.filter(blocks, lambda b: F.substring(digits, b * 128 + 1, F.lit(128)) != empty)
    places = F.flatten(F.transform(used, lambda b: F.sequence(b * 64, F.least(b * 64 + 63, count - 1))))

    def byte(at: Column) -> Column:
        return F.conv(F.substring(digits, at * 2 + 1, F.lit(2)), 16, 10).cast("int")

    whole = F.filter(places, lambda at: byte(at) != 0)
    return F.flatten(
        F.transform(
            whole,
            lambda at: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(byte(at), k) == 1),
                lambda k: (at * 8 + k).cast("long"),
            ),
        )
    )


def _object_privileges(grants_to_roles: DataFrame) -> DataFrame:
    """(effective_role, privilege, granted_on, name) granted on objects, not roles."""
    return (
        live(grants_to_roles)
        .filter(~((F.col("granted_on") == "ROLE") & (F.col("privilege") == "USAGE")))
        .select(F.upper("grantee_name").alias("effective_role"), *PRIVILEGE)
        .distinct()
    )


def effective_privileges(roles: DataFrame, grants_to_roles: DataFrame) -> DataFrame:
    """(role, privilege, granted_on, name): object privileges a role holds or inherits."""
    sets = PrivilegeSets(grants_to_roles)
    return sets.told(sets.of(roles, grants_to_roles)).select("role", *PRIVILEGE)


def privilege_diff(roles: DataFrame, grants_to_roles: DataFrame, legacy: DataFrame) -> DataFrame:
    """Object privileges that only one of two models gives a role, with ``change``.

    Both models' sets are compared word by word; only of those that differ are single
    privileges told, and only those that one side has.
    """
    sets = PrivilegeSets(grants_to_roles, legacy)
    now, then = (
        sets.of(roles, g).withColumnRenamed("bits", name)
        for g, name in ((grants_to_roles, "now"), (legacy, "then"))
    )
    # Roles as they are called in both models: a role may have lost everything.
    both = now.join(then, ["role", "word"], "full").select(
        "role", "word", *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in ("now", "then")]
    )

    def only(here: str, there: str, change: str) -> Column:
        bits = F.col(here).bitwiseAND(F.bitwise_not(there))
        return F.struct(F.lit(change).alias("change"), bits.alias("bits"))

    sides = F.array(only("now", "then", "GAINED"), only("then", "now", "LOST"))
    changes = both.filter("now <> then").select("role", "word", F.inline(sides)).filter("bits <> 0")
    return sets.told(changes).select("role", *PRIVILEGE, "change")


def holds_privilege(roles: DataFrame, grants_to_roles: DataFrame, object_name: str, privilege: str) -> bool:
    """Whether any of ``roles`` holds or inherits a privilege on an object.

    One climb from the roles that were granted it, however many other privileges there are.
    """
    granted = _object_privileges(grants_to_roles).filter(
        (F.col("privilege") == privilege) & (F.col("name") == object_name)
    )
    asked = roles.select(F.upper("role_name").alias("held_role"))
    inherited = _inherited_roles(asked.withColumnRenamed("held_role", "role_name"), role_edges(grants_to_roles))
    return not inherited.join(granted, "effective_role", "left_semi").isEmpty()
