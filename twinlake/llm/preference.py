"""Preference pairs as one prompt and two masked completions; DataFrame expressions only.

The chosen and the rejected conversation of a pair are compared turn by turn (role and text). The longest common
prefix of turns is rendered once as the prompt; what follows in each is its completion. In a completion the text of
assistant turns, with its end mark, carries loss; everything else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(role: Column, text: Column) -> Column:
    """One turn: a role line, the text and an end mark."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _side(turns: DataFrame, pair: str, turn: str, role: str, text: str, name: str) -> DataFrame:
    place = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return turns.select(F.col(pair).alias("__pair"), place.alias("__t"), F.lit(name).alias("__side"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), "")


def _loss(turns: Column) -> Column:
    """Spans of the assistant texts in the rendered completion: 'start-end' in characters, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"]) + 7
        span = F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))
        return F.struct(
            (end + 1).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preference_pairs(
    chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per pair: pair, prompt_turns, prompt, chosen, rejected, chosen_loss, rejected_loss.

    A pair needs a turn on at least one side; a side without turns has the empty completion. NULL role or text counts
    as empty. Turns are ordered by number, then role, then text (NULL numbers first), so repeated rows are repeated
    turns. Completions are empty where a conversation ends with the prompt. Pairs whose key is NULL form one pair.
    A conversation is one output value, so its turns meet in one row; other columns are ignored.
    """
    both = _side(chosen, pair, turn, role, text, "c").unionByName(_side(rejected, pair, turn, role, text, "r"))
    sides = both.groupBy("__pair").agg(
        F.array_sort(F.collect_list(F.when(F.col("__side") == "c", F.col("__t")))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("__side") == "r", F.col("__t")))).alias("r"),
    )
    same = F.zip_with(
        "c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    first_other = F.array_position(same, F.lit(False))
    common = F.when(first_other == 0, F.size("c")).otherwise(first_other - 1).cast("int")
    cut = sides.withColumn("n", common).select(
        "__pair",
        "n",
        F.slice("c", F.lit(1), F.col("n")).alias("p"),
        F.slice("c", F.col("n") + 1, F.size("c")).alias("c"),
        F.slice("r", F.col("n") + 1, F.size("r")).alias("r"),
    )
    return cut.select(
        F.col("__pair").alias(pair),
        F.col("n").cast("long").alias("prompt_turns"),
        _text(F.col("p")).alias("prompt"),
        _text(F.col("c")).alias("chosen"),
        _text(F.col("r")).alias("rejected"),
        _loss(F.col("c")).alias("chosen_loss"),
        _loss(F.col("r")).alias("rejected_loss"),
    )
