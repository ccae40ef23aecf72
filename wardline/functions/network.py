"""IPv4 and IPv6 addresses as keys that sort like the addresses, and sets of networks.

A key is the family (4 or 6) and the address in hexadecimal digits. Networks become
disjoint sorted intervals of keys, so that one binary search tells whether an address
is in any of them, however many there are and however they overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# A key of an IPv4 address that was written as an IPv6 one begins so.
MAPPED = "6" + "0" * 20 + "ffff"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, as a lambda variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a bigint; null if it is not one."""
    parts = F.split(ip, r"\.")
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    in_range = F.size(parts) == 4
    for octet in octets:
        in_range = in_range & octet.between(0, 255)
    return F.when(in_range, number)


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def _long_key(ip: Column) -> Column:
    """The key of an IPv6 address, also of one that ends in a dotted address; null if it is none."""
    text = F.lower(F.substring_index(ip, "%", 1))
    tail = ip_number(F.substring_index(text, ":", -1))
    head = F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, ":", -1)))
    dotted = F.concat(head, _hex(F.shiftright(tail, 16), 4), F.lit(":"), _hex(tail % 65536, 4))
    plain = F.when(F.contains(text, F.lit(".")), dotted).otherwise(text)

    def groups(of: Column) -> Column:
        return F.when(of == "", F.array().cast("array<string>")).otherwise(F.split(of, ":"))

    def filled(halves: Column) -> Column:
        left, right = groups(halves[0]), groups(F.get(halves, F.lit(1)))
        missing = 8 - F.size(left) - F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)).cast("int"))
        return (
            F.when(F.size(halves) == 1, left)
            .when((F.size(halves) == 2) & (missing >= 1), F.concat(left, zeros, right))
        )

    def key(parts: Column) -> Column:
        proper = (F.size(parts) == 8) & F.forall(parts, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        joined = F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(proper, F.concat(F.lit("6"), joined))

    return let(let(F.split(plain, "::"), filled), key)


def _plain_key(ip: Column) -> Column:
    number = ip_number(ip)
    return F.when(F.contains(ip, F.lit(":")), _long_key(ip)).otherwise(
        F.when(number.isNotNull(), F.concat(F.lit("4"), _hex(number, 8)))
    )


def address_key(ip: Column) -> Column:
    """The key of an address, an IPv4 one also where it is written as IPv6; null if it is none."""
    return let(
        _plain_key(ip),
        lambda k: F.when(F.startswith(k, F.lit(MAPPED)), F.concat(F.lit("4"), F.substring(k, 26, 8))).otherwise(k),
    )


def network_bounds(cidrs: DataFrame) -> DataFrame:
    """(policy_name, low, high): first and last key of each proper network in ``cidr``.

    A network without a prefix length is one address.
    """
    stated = F.try_element_at(F.split("cidr", "/"), F.lit(2))
    keyed = cidrs.select(
        "policy_name", _plain_key(F.substring_index("cidr", "/", 1)).alias("key"),
        stated.alias("stated"), stated.try_cast("int").alias("length"),
    )
    # Networks inside the part of IPv6 that stands for IPv4 are IPv4 networks.
    inside = F.startswith("key", F.lit(MAPPED)) & (F.coalesce("length", F.lit(128)) >= 96)
    keyed = keyed.filter("stated IS NULL OR length IS NOT NULL").select(
        "policy_name",
        F.when(inside, F.concat(F.lit("4"), F.substring("key", 26, 8))).otherwise(F.col("key")).alias("key"),
        F.when(inside, F.col("length") - 96).otherwise(F.col("length")).alias("length"),
    )
    width = F.length("key") - 1
    sized = keyed.withColumn("width", width).withColumn("length", F.coalesce("length", width * 4))
    sized = sized.filter(
        "policy_name IS NOT NULL AND key IS NOT NULL AND length BETWEEN 0 AND width * 4"
    )
    # Whole digits of the prefix, and the digit in which it ends.
    whole, over = F.floor(F.col("length") / 4).cast("int"), F.col("length") % 4
    digit = F.conv(F.substring(F.col("key"), whole + 2, F.lit(1)), 16, 10).cast("int")
    spare = F.floor(F.lit(15) / F.pow(F.lit(2), over)).cast("int")
    first = digit - digit.bitwiseAND(spare)
    kept = F.substring(F.col("key"), F.lit(1), whole + 1)
    rest = F.col("width") - whole - 1

    def end(one: Column, fill: str) -> Column:
        more = F.concat(F.lower(F.hex(one.cast("long"))), F.repeat(F.lit(fill), rest))
        return F.when(rest >= 0, F.concat(kept, more)).otherwise(F.col("key"))

    return sized.select("policy_name", end(first, "0").alias("low"), end(first + spare, "f").alias("high"))


def disjoint(bounds: DataFrame) -> DataFrame:
    """(policy_name, low, high): the same keys as of ``bounds``, in intervals that don't overlap."""
    order = W.partitionBy("policy_name").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.coalesce((F.col("low") > before).cast("int"), F.lit(1))
    return (
        bounds.distinct()
        .withColumn("starts", starts)
        .withColumn("run", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy("policy_name", "run")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .drop("run")
    )


def scoped(policy: Column, key: Column) -> Column:
    """One key for a policy and an address: no interval of it reaches into another policy."""
    return F.concat(policy, F.lit("\0"), key)


def searched(key: Column, spans: list[tuple[str, str]]) -> Column:
    """Whether ``key`` is in one of the disjoint ``spans`` (low, high).

    A binary search in two constant arrays, which the tasks get once with the plan: the
    number of spans that begin at or before the key, halved in on.
    """
    if not spans:
        return F.lit(False)
    # Each is one text that is cut once, when the plan is made.
    lows, highs = (F.split(F.lit("\n".join(side)), "\n") for side in zip(*sorted(spans)))

    def step(bounds: Column, _) -> Column:
        middle = F.floor((bounds["above"] + bounds["below"]) / 2).cast("int")
        return let(
            middle,
            lambda m: F.when(
                (bounds["above"] < bounds["below"]) & (F.get(lows, m) <= key),
                F.struct((m + 1).alias("above"), bounds["below"].alias("below")),
            ).otherwise(F.struct(bounds["above"].alias("above"), m.alias("below"))),
        )

    ends = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(spans).bit_length())),
        F.struct(F.lit(0).alias("above"), F.lit(len(spans)).alias("below")),
        step,
    )
    found = let(ends["above"], lambda n: (n > 0) & (F.get(highs, n - 1) >= key))
    return F.coalesce(found, F.lit(False))
