"""Columns profiled in one pass, and classified from what their values are as well as their names.

A profile is made of sketches that merge: of a day's rows, of a partition, of a table that
grows. Nothing of a value is kept but its shape. What a column holds is scored from the
share of values that fit, from its name, and where the values alone prove little, from how
many different ones there are: a name that promises what the values don't bear out does
not count, and neither does a column of city names as one of people.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.conformance import check_digit_holds

SHAPES = 5
SIGNIFICANT = 0.6


class Kind(NamedTuple):
    """What one kind of sensitive value looks like."""

    category: str
    privacy: str
    values: str | None
    names: str
    #: How much of the score the values make up; the name makes up the rest.
    weight: float = 0.75
    check_digit: bool = False
    #: Values that fit must be as varied as this share of the rows, unless the name fits too.
    varied: float = 0.0


#: Most specific first: of kinds with the same score the first is taken.
KINDS = (
    Kind("EMAIL", "IDENTIFIER", r"^[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.[\p{L}]{2,}$", "e.?mail"),
    Kind("US_SSN", "IDENTIFIER", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", r"ssn|social"),
    Kind(
        "IP_ADDRESS", "IDENTIFIER",
        r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$|^[0-9a-fA-F:.]*::[0-9a-fA-F:.]*$",
        r"\bip\b|ip_addr|client_ip",
    ),
    Kind("MEDICAL_RECORD", "IDENTIFIER", r"^MRN-?[0-9]+$", "mrn|medical_record"),
    Kind("PAYMENT_CARD", "IDENTIFIER", r"^[0-9](?:[ -]?[0-9]){12,18}$", "card|pan", check_digit=True),
    Kind(
        "PHONE_NUMBER", "IDENTIFIER",
        r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){1,3}$|^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$",
        "phone|mobile|fax",
    ),
    # A date alone says nothing about whose it is.
    Kind("DATE_OF_BIRTH", "QUASI_IDENTIFIER", r"^(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}", r"dob|birth", weight=0.5),
    Kind("NAME", "IDENTIFIER", r"^\p{Lu}[\p{Ll}'-]+( \p{Lu}[\p{Ll}.'-]*)+$", r"(full|first|last|patient|user)_?name", varied=0.2),
)


def shape(value: Column) -> Column:
    """A value with its letters, digits and runs of them reduced to one sign each."""
    cut = F.left(value, F.lit(64))
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), ("[0-9]+", "9"), (r"\s+", " "), (r"([Aa9])\1+", "$1")):
        cut = F.regexp_replace(cut, pattern, sign)
    return cut


def profile(df: DataFrame, columns: list[str] | None = None, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row of mergeable sketches for each column of a simple type.

    (column_name, data_type, rows, filled, different, lengths, shapes, fits): rows that
    aren't blank, sketches of distinct values, lengths and shapes, and how many values fit
    each of ``kinds``. All columns are measured in one aggregate over the table; only that row is turned.
    """
    wanted = [f for f in df.schema.fields if columns is None or f.name in columns]
    simple = (T.AtomicType,)
    measures, entries = [], []
    for at, field in enumerate(f for f in wanted if isinstance(f.dataType, simple)):
        value = F.col(f"`{field.name}`").cast("string")
        filled = F.when(F.trim(value) != "", value)
        made = {
            "rows": F.count(F.lit(1)), "filled": F.count(filled),
            "different": F.hll_sketch_agg(filled), "lengths": F.kll_sketch_agg_bigint(F.length(filled).cast("bigint")),
        }
        for n, kind in enumerate(kinds):
            fits = filled.rlike(kind.values)
            if kind.check_digit:
                fits = F.when(fits, check_digit_holds(F.regexp_replace(filled, "[ -]", "")))
            made[f"k{n}"] = F.count_if(fits)
        measures += [m.alias(f"c{at}_{name}") for name, m in made.items()]
        # A sketch of the most frequent shapes; of texts only their beginnings.
        shaped = f"approx_top_k_accumulate(c{at}_shape)"
        measures.append(F.expr(shaped).alias(f"c{at}_shapes"))
        entries.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                *[F.col(f"c{at}_{name}").alias(name) for name in ("rows", "filled", "different", "lengths", "shapes")],
                F.array(*[F.col(f"c{at}_k{n}") for n in range(len(kinds))]).alias("fits"),
            )
        )
    names = [f.name for f in wanted if isinstance(f.dataType, simple)]
    shapes = {f"c{at}_shape": shape(F.col(f"`{name}`").cast("string")) for at, name in enumerate(names)}
    measured = df.select("*", *[c.alias(n) for n, c in shapes.items()]).agg(*measures)
    return measured.select(F.inline(F.array(*entries)))


def merged(profiles: list[DataFrame]) -> DataFrame:
    """One profile of several of the same columns."""
    every = reduce(DataFrame.unionByName, profiles)
    sums = F.aggregate(
        F.collect_list("fits"), F.array_repeat(F.lit(0).cast("bigint"), len(KINDS)),
        lambda total, one: F.zip_with(total, one, lambda a, b: a + b),
    )
    return every.groupBy("column_name", "data_type").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"),
        F.hll_union_agg("different").alias("different"),
        F.kll_merge_agg_bigint("lengths").alias("lengths"),
        F.expr("approx_top_k_combine(shapes)").alias("shapes"), sums.alias("fits"),
    )


def described(profiles: DataFrame) -> DataFrame:
    """Profiles in figures: (column_name, data_type, rows, filled, different, shortest, median,
    longest, top_shapes)."""
    length = [
        F.when(F.col("filled") > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(rank))).alias(name)
        for name, rank in (("shortest", 0.0), ("median", 0.5), ("longest", 1.0))
    ]
    top = F.transform(F.expr(f"approx_top_k_estimate(shapes, {SHAPES})"), lambda s: s["item"])
    return profiles.select(
        "column_name", "data_type", "rows", "filled", F.hll_sketch_estimate("different").alias("different"),
        *length, top.alias("top_shapes"),
    )


def classify_profiles(profiles: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(column_name, semantic_category, privacy_category, score, evidence) of sensitive columns.

    ``evidence`` is VALUES, NAME_AND_VALUES, or NAME where a column has no values yet. A
    mixed column counts by the share of its values that fit.
    """
    filled = F.col("filled")
    found = []
    for n, kind in enumerate(kinds):
        named = F.col("column_name").rlike(f"(?i){kind.names}")
        share = F.when(filled > 0, F.get("fits", F.lit(n)) / filled).otherwise(0.0)
        varied = F.hll_sketch_estimate("different") >= kind.varied * filled
        values = F.when(varied | named, share).otherwise(0.0) if kind.varied else share
        score = F.when(filled == 0, named.cast("double") * SIGNIFICANT).otherwise(
            kind.weight * values + (1 - kind.weight) * named.cast("double")
        )
        found.append(
            F.struct(
                score.alias("score"), F.lit(-n).alias("order"), F.lit(kind.category).alias("semantic_category"),
                F.lit(kind.privacy).alias("privacy_category"),
                F.when(filled == 0, "NAME").when(named, "NAME_AND_VALUES").otherwise("VALUES").alias("evidence"),
            )
        )
    best = F.array_max(F.array(*found))
    return profiles.withColumn("best", best).filter(F.col("best.score") >= SIGNIFICANT).select(
        "column_name", "best.semantic_category", "best.privacy_category", "best.score", "best.evidence"
    )
