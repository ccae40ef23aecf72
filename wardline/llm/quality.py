"""Quality rules with thresholds that adapt to each language and source.

Every text is measured by array functions of its own row. Two rules are fixed (too
few words, too much repetition); the others compare a share with a fence learned
from the corpus: mergeable KLL sketches of each measure by (lang, source) are merged
to sketches by language and of everything, and a measure fails if it lies more than
``FENCE`` quartile distances outside the middle half of its group. A group of fewer
than ``LEAST`` rows uses its language's sketch, and a language of fewer the corpus's.
A measure's quartile distance counts as ``LEAST_SPREAD`` at least, so that where
nearly all texts are alike a single symbol is not an offence.

Sketches are exact for groups up to about ``SKETCH`` rows and randomised beyond;
the fences are written out once, so every row meets the same ones.

Nulls and odd input: a null or empty text has no words and fails; null language and
source are groups of their own; repeated rows each come back; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import common
from wardline.llm.common import let

LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SKETCH = 2048
LEAST = 200
FENCE = 3.0
LEAST_SPREAD = {"symbol_share": 0.02, "dup_line_share": 0.1, "word_length": 0.5}

_SPLIT = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPLIT, -1), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more.

    Windows are compared by hash; only a text with equal ones has them sorted, to see
    which, and its covered words summed from one such window to the next.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1), x + window) - x)
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(marks: Column) -> Column:
        ordered = F.sort_array(F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(row: Column) -> Column:
            kept = F.transform(
                row,
                lambda x, k: F.when(
                    (x["h"] == F.get(row, k - 1)["h"]) | (x["h"] == F.get(row, k + 1)["h"]), x["i"]
                ),
            )
            return F.sort_array(F.filter(kept, lambda i: i.isNotNull()))

        return let(let(ordered, repeated), covered)

    def compare(marks: Column) -> Column:
        alike = F.size(F.array_distinct(marks)) == F.size(marks)
        return F.when(alike, F.lit(0).cast("long")).otherwise(places(marks))

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, window)))

    return F.when(
        F.size(words) > window,
        let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), compare),
    ).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.translate(text, common.SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, common.SPACES, "") != "")
    counted = let(
        words_of(text),
        lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")),
    )
    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")
        ),
    )
    rows = docs.select(
        F.col("doc_id").cast("long"), "lang", "source", counted.alias("words"),
        by_line.alias("lines"), F.char_length(blank).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")))
        .cast("long").alias("n_symbols"),
    )
    return rows.select(
        "doc_id", "lang", "source",
        F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.again").cast("long").alias("n_dup_lines"),
        F.col("words.repeated").alias("n_repeat_words"),
        (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_share"),
        (F.col("lines.again") / F.greatest("lines.n", F.lit(1))).alias("dup_line_share"),
        (F.col("word_chars") / F.greatest("words.n", F.lit(1))).alias("word_length"),
    )


def fences(rows: DataFrame) -> DataFrame:
    """(lang, source, low and high fence of each measure), null-safe keys."""
    names = list(LEAST_SPREAD)
    small = rows.groupBy("lang", "source").agg(
        F.count("*").alias("n"),
        *[F.kll_sketch_agg_double(m, F.lit(SKETCH)).alias(m) for m in names],
    )
    small = common.cut_lineage(small)

    def merged(keys: list[str], ending: str) -> DataFrame:
        return small.groupBy(*keys).agg(
            F.sum("n").alias("n" + ending),
            *[F.kll_merge_agg_double(m, F.lit(SKETCH)).alias(m + ending) for m in names],
        )

    by_lang = merged(["lang"], "_lang").withColumnRenamed("lang", "_lang")
    every = merged([], "_all")
    both = small.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).join(
        F.broadcast(every)  # one row
    )
    limits = []
    for measure, least in LEAST_SPREAD.items():
        sketch = (
            F.when(F.col("n") >= LEAST, F.col(measure))
            .when(F.col("n_lang") >= LEAST, F.col(measure + "_lang"))
            .otherwise(F.col(measure + "_all"))
        )
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        spread = F.greatest(high - low, F.lit(least)) * FENCE
        limits += [(low - spread).alias(measure + "_low"), (high + spread).alias(measure + "_high")]
    return common.cut_lineage(
        both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *limits)
    )


def judge(docs: DataFrame) -> DataFrame:
    """The measures of every text, ``base_failed``, and ``kept``."""
    rows = common.cut_lineage(measures(docs))
    limits = fences(rows)
    joined = rows.join(
        limits,
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    inside = F.lit(True)
    for measure in LEAST_SPREAD:
        inside &= F.coalesce(
            F.col(measure).between(F.col(measure + "_low"), F.col(measure + "_high")), F.lit(True)
        )
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"),
        "symbol_share", "dup_line_share", "word_length",
    )
