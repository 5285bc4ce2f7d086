"""Chat formatting of preference pairs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"
TRAINED_ROLE = "assistant"


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE))


def _gather(only: Column | None = None) -> Column:
    """Turns of a group as an array of (turn, role, text); order: turn (nulls first), role, text."""
    clean = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return F.sort_array(F.collect_list(clean if only is None else F.when(only, clean)))


def _turns(side: DataFrame, name: str) -> DataFrame:
    return side.groupBy("pair_id").agg(_gather().alias(name))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Spans [start, end) of characters that are trained on: text and end mark of the assistant's turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("spans"))

    def step(acc, t):
        s = acc["at"] + F.length(head(t["role"]))
        e = s + F.length(t["text"]) + len(END)
        span = F.array(F.struct(s.cast("long").alias("s"), e.cast("long").alias("e")))
        return F.struct(e.cast("long").alias("at"),
                        F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows ``(pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask)``.

    Both inputs hold turns ``(pair_id, turn, role, text)``.  The longest common prefix of turns
    (equal role and text, null as empty) is rendered once as prompt; what follows on each side is a
    completion with the spans of its assistant turns, in characters of the completion.  Pairs with
    one side only get an empty list on the other.  Turns that repeat a number are ordered by role
    and text; numbers themselves do not count.  Identical sides have empty completions.  A pair is
    one training example and so one row: it is gathered per pair, which no other pair shares, so
    common first turns or conversations do not meet in one task.  Other columns are not read; a
    null pair_id is dropped, as such turns have no pair.
    """
    cols = ("pair_id", "turn", "role", "text")
    sides = [_turns(side.select(*cols).filter("pair_id is not null"), name) for side, name in ((chosen, "c"), (rejected, "r"))]
    none = F.array().cast(sides[0].schema["c"].dataType)
    both = sides[0].join(sides[1], "pair_id", "full").select(
        "pair_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    return _formatted(both)


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """``preference_pairs`` rows in which every conversation ``(conv_id, turn, role, text)`` is chosen once.

    pair_id is the chosen conversation's id.  Conversations 2k and 2k+1 are partners: the rejected
    side is the first half of the chosen one's turns (rounded down), then the partner's turns from
    that position on; a missing or shorter partner adds nothing.  Positions count rows in the order
    of turn (nulls first), role, text, so that null, repeated and skipped turn numbers keep their
    rows.  Turns with a null conv_id belong to no conversation and are left out; no rows give no
    rows.  Other columns are not read.  Both partners are gathered in one group, which holds no
    other conversation.
    """
    odd = F.pmod("conv_id", F.lit(2)) == 1
    both = (conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
            .groupBy((F.col("conv_id") - F.pmod("conv_id", F.lit(2))).alias("even"))
            .agg(_gather(~odd).alias("a"), _gather(odd).alias("b")))

    def pair(pair_id, c, other):
        half = F.floor(F.size(c) / 2).cast("int")
        r = F.concat(F.slice(c, F.lit(1), half), F.slice(other, half + 1, F.size(other)))
        return F.struct(pair_id.cast("long").alias("pair_id"), F.col(c).alias("c"), r.alias("r"))

    sides = F.array(pair(F.col("even"), "a", "b"), pair(F.col("even") + 1, "b", "a"))
    return _formatted(both.select(F.explode(sides).alias("p")).select("p.*").filter(F.size("c") > 0))


def _formatted(both: DataFrame) -> DataFrame:
    """Rows of ``preference_pairs`` from the ordered turns ``(pair_id, c, r)`` of both sides."""
    same = lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"])
    equal = F.zip_with(F.col("c"), F.col("r"), lambda a, b: F.coalesce(same(a, b), F.lit(False)))
    # 1-based place of the first difference; none: as many turns as the longer side has, which equal each other
    first = F.coalesce(F.array_position(equal, F.lit(False)), F.lit(0)).cast("int")
    both = both.select("*", F.when(first > 0, first - 1).otherwise(F.size("c")).alias("k"))
    rest = lambda x: F.slice(F.col(x), F.col("k") + 1, F.size(x))
    both = both.select("pair_id", "k", F.slice("c", F.lit(1), F.col("k")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select("pair_id", F.col("k").alias("prompt_turns"), _render(F.col("p")).alias("prompt"),
                       _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"),
                       _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))
