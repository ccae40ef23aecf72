"""Chat formatting in budgeted windows.

A conversation's turns, in order, are cut at turn boundaries into windows by prefix
sums of their token counts (estimated as a quarter of the characters, and four for
the turn's marks): a turn belongs to the slot of ``SLOT`` tokens that its last token
lies in, and a turn longer than a slot is alone. So no turn needs to know where the
previous window ended. A window starts with the conversation's system turn and up to
``HISTORY_TURNS`` turns from before, of at most ``HISTORY`` tokens together; both are
repeated and bear no loss. Each assistant text bears loss once, in its own window. A
window stays within ``BUDGET`` unless its system turn or one turn alone is longer;
texts are never cut.

Prefix sums run within chunks of ``CHUNK`` turns, where a window always ends and
history starts anew, so a conversation of any length is spread over tasks.

Marks are ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.
In texts and roles the escape character is written as itself and 0, the ``|`` after a
``<`` as it and 1, in roles a line feed as it and 2; so no control string can stand in
a text, and reading back is exact.

Nulls and odd input: null texts and roles are empty; a null conversation is one of its
own; a null turn comes before all others; turns of equal number are ordered by role
and text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import let

BUDGET = 2048
HISTORY = 256
HISTORY_TURNS = 2
SYSTEM = 512
SLOT = (BUDGET - SYSTEM - HISTORY) // 2
CHUNK = 1024
ESCAPE = "␛"
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column, line_feeds: bool = False) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    text = F.replace(text, F.lit("<|"), F.lit("<" + ESCAPE + "1"))
    return F.replace(text, F.lit("\n"), F.lit(ESCAPE + "2")) if line_feeds else text


def unescaped(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE + "2"), F.lit("\n"))
    text = F.replace(text, F.lit(ESCAPE + "1"), F.lit("|"))
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _written(turns: Column) -> Column:
    """Text of (role, text, loss) turns with their marks, and the spans that bear loss."""
    nothing = F.struct(
        F.lit("").alias("formatted"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("loss"),
    )

    def add(sofar: Column, turn: Column) -> Column:
        head = F.concat(sofar["formatted"], F.lit(START), escaped(turn["role"], True), F.lit("\n"))
        body = escaped(turn["text"])
        span = F.struct(
            F.char_length(head).alias("start"),
            (F.char_length(head) + F.char_length(body)).alias("end"),
        )
        return F.struct(
            F.concat(head, body, F.lit(END + "\n")).alias("formatted"),
            F.when(turn["loss"], F.concat(sofar["loss"], F.array(span)))
            .otherwise(sofar["loss"]).alias("loss"),
        )

    return F.aggregate(turns, nothing, add)


def windows(conversations: DataFrame) -> DataFrame:
    """One row for each window, in ``place`` order within (conv_id, chunk).

    Columns: conv_id, chunk, place, repeated (how many turns at its start are there
    for context), tokens, formatted, loss (spans of characters, end exclusive).
    """
    text = F.coalesce("text", F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), text.alias("text"),
        F.coalesce(F.expr(f"floor(turn / {CHUNK})"), F.lit(-(1 << 62))).alias("chunk"),
        (F.ceil(F.char_length(text) / 4) + 4).cast("long").alias("tokens"),
    )
    opening = turns.groupBy("conv_id").agg(
        F.min(F.struct("chunk", "turn", "role", "text", "tokens")).alias("first")
    ).where("first.role = 'system'").select(F.col("conv_id").alias("_conv"), "first")
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    far = F.col("tokens") > SLOT
    placed = turns.select(
        "*", F.row_number().over(order).alias("place"),
        F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("through"),
        F.sum(far.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("longs"),
        F.array(
            *[
                F.lag(F.struct("role", "text", "tokens"), n).over(order)
                for n in range(HISTORY_TURNS, 0, -1)
            ]
        ).alias("before"),
    )
    slot = F.when(far, F.lit(-1)).otherwise(F.floor((F.col("through") - 1) / SLOT))
    cut = placed.groupBy("conv_id", "chunk", "longs", slot.alias("slot")).agg(
        F.min("place").alias("place"),
        F.sum("tokens").alias("tokens"),
        F.sort_array(
            F.collect_list(
                F.struct("place", "role", "text", (F.col("role") == "assistant").alias("loss"))
            )
        ).alias("turns"),
        F.min_by("before", "place").alias("before"),
    )
    joined = cut.join(opening, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    # The first window holds the system turn itself; after it, it is context.
    starts = (F.col("place") == 1) & (F.col("chunk") == F.col("first.chunk"))
    kept = F.filter("before", lambda t: t.isNotNull())
    # The opening system turn is not history: it is repeated anyway.
    count = F.when(
        F.col("first").isNotNull() & (F.col("chunk") == F.col("first.chunk")), F.col("place") - 2
    ).otherwise(F.col("place") - 1)
    history = F.slice(
        F.reverse(kept), F.lit(1), F.greatest(F.lit(0), F.least(F.size(kept), count))
    )

    def affordable(near: Column) -> Column:
        fits = F.transform(
            near,
            lambda t, n: F.aggregate(
                F.slice(near, F.lit(1), n + 1), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]
            )
            <= HISTORY,
        )
        return F.reverse(F.filter(near, lambda t, n: F.get(fits, n)))

    silent = F.transform(
        let(history, affordable),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(False).alias("loss")),
    )
    system = F.when(
        F.col("first").isNotNull() & ~starts,
        F.array(
            F.struct(
                F.col("first.role").alias("role"), F.col("first.text").alias("text"),
                F.lit(False).alias("loss"),
            )
        ),
    ).otherwise(F.expr("cast(array() as array<struct<role:string,text:string,loss:boolean>>)"))
    own = F.transform(
        "turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["loss"].alias("loss"))
    )
    written = let(
        F.concat(system, silent),
        lambda context: F.struct(
            F.size(context).alias("repeated"), _written(F.concat(context, own)).alias("w")
        ),
    )
    return joined.select("conv_id", "chunk", "place", "tokens", written.alias("all")).select(
        "conv_id", "chunk", "place", F.col("all.repeated").alias("repeated"), "tokens",
        F.col("all.w.formatted").alias("formatted"), F.col("all.w.loss").alias("loss"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, chunk, place, turns, targets): turns and loss texts parsed from windows."""
    pieces = F.split("formatted", START.replace("|", r"\|"), -1)
    own = F.slice(pieces, F.col("repeated") + 2, F.size(pieces))
    turns = F.transform(
        own,
        lambda p: F.struct(
            unescaped(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(
                F.substring(
                    p, F.instr(p, "\n") + 1,
                    F.char_length(p) - F.instr(p, "\n") - (len(END) + 1),
                )
            ).alias("text"),
        ),
    )
    targets = F.transform(
        "loss",
        lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])),
    )
    return made.select(
        "conv_id", "chunk", "place", turns.alias("turns"), targets.alias("targets"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
