"""Preference formatting of chosen and rejected conversations.

Both conversations of a pair start with the same turns: their longest common prefix is
rendered once as the prompt, what follows in each is rendered as its completion, and
the completion's loss mask marks the text (with its end marker) of assistant turns.
Only DataFrame functions: a conversation is collected by its id after repeated turn
rows are dropped, and everything else is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
NO_ROLE = "unknown"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns, array<struct<role, text>>, by turn number.

    Rows with a null id belong to no conversation. Repeated rows count once; turns of equal
    number stand by role and text; a null number comes first.
    """
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).distinct()
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).withColumnRenamed("id", id_col)


def common_turns(a: Column, b: Column) -> Column:
    """The length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise((first - 1).cast("int"))


def _safe(text: Column) -> Column:
    """A text can't forge the template's markers."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _safe(F.coalesce(turn["role"], F.lit(NO_ROLE))), F.lit(MIDDLE))


def _tail(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def trained_spans(turns: Column) -> Column:
    """array<struct<start, stop>>: code points of the rendered turns that count in the loss."""
    sizes = F.transform(turns, lambda t: F.struct(F.length(_head(t)).alias("head"), F.length(_tail(t)).alias("tail"), F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False)).alias("on")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin, stop = acc["at"] + s["head"], acc["at"] + s["head"] + s["tail"]
        span = F.struct(begin.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(s["on"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, start, step)["spans"]


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Every row with ``prompt``, ``prompt_turns``, ``chosen``, ``rejected`` (texts) and
    ``chosen_mask``, ``rejected_mask`` (spans); the two columns of turns are replaced.

    A null array counts as empty, a null text too, a null role is ``unknown``. Equal
    conversations have empty completions. Columns of the six names are replaced; other
    columns pass through.
    """
    new = ("prompt", "prompt_turns", "chosen", "rejected", "chosen_mask", "rejected_mask")
    cols = [c for c in pairs.columns if c not in {*new, chosen_col, rejected_col}]
    empty = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row") if cols else F.lit(0).alias("row"), F.coalesce(chosen_col, empty).alias("a"), F.coalesce(rejected_col, empty).alias("b"))
    cut = both.withColumn("k", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("k") + 1, F.greatest(F.size(c) - F.col("k"), F.lit(0)))
    cut = cut.select("row", "k", F.slice("a", F.lit(1), F.col("k")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return cut.select(
        *[F.col("row")[c].alias(c) for c in cols],
        rendered(F.col("p")).alias("prompt"),
        F.col("k").cast("long").alias("prompt_turns"),
        rendered(F.col("a")).alias("chosen"),
        rendered(F.col("b")).alias("rejected"),
        trained_spans(F.col("a")).alias("chosen_mask"),
        trained_spans(F.col("b")).alias("rejected_mask"),
    )


def with_stale_reply(talks: DataFrame, id_col: str = "conv_id", turns_col: str = "turns") -> DataFrame:
    """(.., chosen, rejected) from single conversations: ``chosen`` is every turn; ``rejected`` is
    the same but for one assistant turn, at a place drawn by a hash of the id, whose text is
    the assistant turn's before it or, at the first one, its own first sentence.

    Turns after the drawn one stay in both, so completions hold as many trained turns as follow.
    Without an assistant turn, or where the stale text is the text itself, both are equal.
    A null id is drawn like an empty text.
    """
    turns = F.col(turns_col)
    places = F.transform(turns, lambda t, i: F.struct((i + 1).alias("at"), t["role"].alias("role"), t["text"].alias("text")))
    got = talks.withColumn("__replies", F.filter(places, lambda t: F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False))))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    got = got.withColumn("__k", F.when(F.size("__replies") > 0, F.pmod(draw, F.size("__replies")).cast("int") + 1))
    here = F.try_element_at("__replies", F.col("__k"))
    before = F.try_element_at("__replies", F.greatest(F.col("__k") - 1, F.lit(1)))
    stale = F.when(F.col("__k") > 1, before["text"]).otherwise(F.regexp_extract(here["text"], r"^[^.!?]*[.!?]?", 0))
    got = got.withColumn("__stale", F.struct(here["at"].alias("at"), stale.alias("text")))
    other = F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col("__stale")["at"], F.col("__stale")["text"]).otherwise(t["text"]).alias("text")))
    return got.withColumn("chosen", turns).withColumn("rejected", other).drop(*{"__replies", "__k", "__stale", turns_col} - {"chosen", "rejected"})
