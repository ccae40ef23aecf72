"""Secret scans with a trigram inverted index.

From each rule's regular expression follows a Boolean query of trigrams that any match
must contain: literal stretches, with small alternatives spelled out, are joined by
"and", their alternatives by "or". The index lists, for each trigram that occurs in a
query, the texts (lower-cased) that contain it. Intersecting the lists gives each
rule's candidates, and only those are searched with the expression itself. A rule
without a mandatory trigram (a run of hexadecimal digits) is searched in every text.

Matches are leftmost and do not overlap within a rule. Their places are character
positions, from the lengths of what lies between matches, summed in a logarithmic
number of steps so that a long text with many matches stays cheap.

Nulls and odd input: a null text is empty; null ids are looked up like any other;
repeated ids share their candidates and are searched row by row; an empty table gives
no rows; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import itertools
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import common
from wardline.llm.common import let

MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """``least`` is how many characters group ``group`` of a match must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base; spans at one place are listed in this order.
RULES = [
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    # Only whole runs match, so a run's least length can be part of the expression.
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
]
BASE = ("assign", "access", "hex")

#: Strings that a literal stretch may be spelled out into.
ALTERNATIVES = 64
#: Enough for one match in every 16 characters of the longest possible text.
DOUBLINGS = 27
#: Characters of a text that are masked at once.
MASK_BLOCK = 8192

#: Any of these sets of trigrams, all of the set; a query is a list of such choices.
Choice = list[frozenset[str]]


def trigrams(pattern: str) -> list[Choice]:
    """The trigram query of a regular expression; empty if nothing is mandatory."""
    import re._parser as parser

    stretches: list[set[str]] = []
    _walk(parser.parse(pattern), {""}, stretches)
    choices = []
    for strings in stretches:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        # A set that contains another adds nothing to the choice.
        choice = sorted(
            (s for s in sets if not any(other < s for other in sets)), key=sorted
        )
        if all(choice) and choice not in choices:
            choices.append(choice)
    return choices


def _walk(nodes, held: set[str], done: list[set[str]]) -> None:
    """Collects the stretches of a sequence; ``held`` are the strings it begins with."""
    for kind, value in nodes:
        name = str(kind)
        options = _options(name, value)
        if options is not None and len(held) * len(options) <= ALTERNATIVES:
            held = {a + b for a, b in itertools.product(held, options)}
            continue
        done.append(held)
        held = options if options is not None and len(options) <= ALTERNATIVES else {""}
        if options is None and name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            # At least once: what it begins with is mandatory, what follows is open.
            first = _all(value[2])
            if first is not None:
                done.append(first)
    done.append(held)


def _all(nodes) -> set[str] | None:
    """All strings of a short sequence, None if there are too many."""
    held = {""}
    for kind, value in nodes:
        options = _options(str(kind), value)
        if options is None or len(held) * len(options) > ALTERNATIVES:
            return None
        held = {a + b for a, b in itertools.product(held, options)}
    return held


def _options(name: str, value) -> set[str] | None:
    """The lower-cased strings that a node stands for, None if they are too many."""
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
        return {chr(v).lower() for _, v in value}
    if name == "SUBPATTERN":
        return _all(value[3])
    if name == "BRANCH":
        each = [_all(nodes) for nodes in value[1]]
        return None if None in each else set().union(*each)
    if name == "MAX_REPEAT" and tuple(value[:2]) == (0, 1):
        inner = _all(value[2])
        return None if inner is None else inner | {""}
    return None


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, doc_id): the index of the ``wanted`` trigrams."""
    lowered = _lower(F.coalesce("text", F.lit("")))
    present = let(
        lowered,
        lambda t: F.filter(F.array(*map(F.lit, wanted)), lambda g: F.contains(t, g)),
    )
    return docs.select(F.explode(present).alias("trigram"), F.col("doc_id").cast("long"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a text answers."""
    queries = {r.kind: trigrams(r.pattern) for r in rules}
    wanted = sorted({g for q in queries.values() for c in q for s in c for g in s})
    if not wanted:
        return docs.select(F.col("doc_id").cast("long"), F.array().alias("kinds")).limit(0)
    found = postings(docs, wanted).groupBy("doc_id").agg(F.collect_set("trigram").alias("has"))

    def answered(query: list[Choice]) -> Column:
        all_of = F.lit(True)
        for choice in query:
            any_of = F.lit(False)
            for grams in choice:
                wanted_here = F.array(*map(F.lit, sorted(grams)))
                any_of |= F.size(F.array_intersect("has", wanted_here)) == len(grams)
            all_of &= any_of
        return all_of

    kinds = F.array(*[F.when(answered(q), F.lit(k)) for k, q in queries.items() if q])
    return found.select("doc_id", F.array_compact(kinds).alias("kinds")).where(F.size("kinds") > 0)


def _running(values: Column) -> Column:
    """Prefix sums of an array of integers."""

    def doubled(step: int):
        def add(a: Column) -> Column:
            summed = F.transform(
                a, lambda x, i: F.when(i >= step, x + F.get(a, i - step)).otherwise(x)
            )
            return F.when(F.size(a) <= step, a).otherwise(summed)

        return add

    for n in range(DOUBLINGS):
        values = let(values, doubled(1 << n))
    return values


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """What a rule finds in a text: its matches, and the text between them."""
    return F.when(
        text.rlike(rule.pattern),
        F.struct(
            F.split(text, rule.pattern, -1).alias("between"),
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hits"),
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("tested"),
            F.lit(rule.least).alias("least"), F.lit(order).alias("place"),
            F.lit(rule.kind).alias("kind"),
        ),
    )


def _located(found: Column) -> Column:
    """Spans (start, place in the list, end, kind) of a rule's matches."""
    ends = _running(
        F.transform(
            found["hits"],
            lambda h, k: F.char_length(h) + F.char_length(F.get(found["between"], k)),
        )
    )
    every = F.transform(
        ends,
        lambda e, k: F.when(
            F.char_length(F.get(found["tested"], k)) >= found["least"],
            F.struct(
                (e - F.char_length(F.get(found["hits"], k))).alias("start"),
                found["place"].alias("place"), e.alias("end"), found["kind"].alias("kind"),
            ),
        ),
    )
    return F.filter(every, lambda s: s.isNotNull())


def _searched(rows: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """All columns of ``rows`` and ``found``: the spans of its ``text`` column, sorted."""
    named = rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    asked = candidates(named, rules).select(F.col("doc_id").alias("asked"), "kinds")
    joined = rows.join(asked, F.col(key).cast("long").eqNullSafe(F.col("asked")), "left")
    content = F.coalesce(text, F.lit(""))
    each = []
    for order, rule in enumerate(rules):
        found = _matches(content, rule, order)
        if trigrams(rule.pattern):
            wanted = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
            found = F.when(wanted, found)
        each.append(found)
    spans = F.flatten(F.transform(F.array_compact(F.array(*each)), _located))
    return joined.select(*rows.columns, F.sort_array(spans).alias("found"))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, spans): array of (start, place, end, kind) of every text."""
    rows = docs.select("doc_id", "text")
    return _searched(rows, "doc_id", "text", rules).select(
        F.col("doc_id").cast("long"), F.col("found").alias("spans")
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with ``mask`` in place of sorted spans.

    Written block by block, so that the cost of a long text with many spans does not
    grow with their product. A span that began in an earlier block has its mask there.
    """
    # Possessive, as a greedy repeat would recurse on every change of a character's width.
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{MASK_BLOCK}}}+"), F.lit(0))

    def rewritten(block: Column, number: Column) -> Column:
        low = number * MASK_BLOCK
        inside = F.filter(spans, lambda s: (s["start"] < low + MASK_BLOCK) & (s["end"] > low))

        def add(sofar: Column, span: Column) -> Column:
            fresh = span["start"] >= sofar["at"]
            between = F.substring(block, sofar["at"] - low + 1, span["start"] - sofar["at"])
            return F.struct(
                F.when(fresh, F.concat(sofar["out"], between, F.lit(mask)))
                .otherwise(sofar["out"]).alias("out"),
                F.greatest(span["end"], sofar["at"]).alias("at"),
            )

        def finish(done: Column) -> Column:
            return F.concat(done["out"], F.substring(block, done["at"] - low + 1, F.lit(MASK_BLOCK)))

        start = F.struct(F.lit("").alias("out"), low.alias("at"))
        return F.aggregate(inside, start, add, finish)

    return F.array_join(F.transform(blocks, rewritten), "")


def redact(docs: DataFrame, rules: list[Rule] = RULES, mask: str = MASK) -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``mask``.

    Keeps all columns; ``n_chars``, if there is one, is that of the new text.
    """
    at = {name: f"c{n}" for n, name in enumerate(docs.columns)}
    rows = _searched(common.numbered(docs), at["doc_id"], at["text"], rules)
    text, spans = F.col(at["text"]), F.col("found")
    some = F.size(spans) > 0
    masked = F.when(some, _masked(text, spans, mask)).otherwise(text)
    rows = rows.withColumn(at["text"], masked)
    if "n_chars" in at:
        size = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn(at["n_chars"], F.when(some, size).otherwise(F.col(at["n_chars"])))
    return common.renamed(rows, docs)
