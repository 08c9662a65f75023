"""Operator 8 - preference formatting of chosen and rejected conversations (DataFrame only).

The two sides of a pair are joined turn by turn. The first turn at which they
differ (in role or text, or because one side ends) cuts the pair: turns before it
are the longest common prefix and are rendered once as the prompt, the rest of
either side is its completion. Prompt turns are never trained on; in completions
the assistant's turns are, the others are masked.

The result has a row per rendered turn. Nothing is gathered by conversation:
the join is on (pair, turn) and the cut is a minimum with map-side partial
results, so a conversation of any length is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(role: Column, text: Column) -> Column:
    """Chat mark-up of one turn."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def preference_turns(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``(pair_id, part, turn, role, rendered, train)`` for ``turns`` with
    ``pair_id``, ``chosen`` (boolean: which side), ``turn``, ``role``, ``text``.

    ``part`` is prompt, chosen or rejected. A null role or text equals only
    another null and renders as ``unknown`` or nothing. Rows with a null pair,
    side or turn belong to no conversation and are left out. Of several rows for
    one turn the smallest (role, text) counts, so repeated rows change nothing.
    Equal sides are all prompt; a pair with one side has no prompt and that
    side's completion. Empty texts render as an empty turn; empty table, empty
    result.
    """
    clean = (turns.where("pair_id IS NOT NULL AND chosen IS NOT NULL AND turn IS NOT NULL")
             .groupBy("pair_id", "chosen", "turn").agg(F.min(F.struct("role", "text")).alias("said")))
    side = lambda flag, name: clean.where(F.col("chosen") == flag).select("pair_id", "turn", F.col("said").alias(name))
    both = side(True, "a").join(side(False, "b"), ["pair_id", "turn"], "full")
    cuts = both.groupBy("pair_id").agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("turn"))).alias("cut"))
    met = both.join(cuts, "pair_id")
    before = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    part = lambda name, said: F.when(F.col(said).isNotNull(), F.struct(F.lit(name).alias("part"), F.col(said).alias("said")))
    parts = F.when(before, F.array(part("prompt", "a"))).otherwise(F.array(part("chosen", "a"), part("rejected", "b")))
    rows = met.select("pair_id", "turn", F.explode(F.array_compact(parts)).alias("p"))
    return rows.select(
        "pair_id", "p.part", "turn", "p.said.role", render(F.col("p.said.role"), F.col("p.said.text")).alias("rendered"),
        ((F.col("p.part") != "prompt") & F.coalesce(F.col("p.said.role") == trained_role, F.lit(False))).alias("train"))


def assemble(parts: DataFrame) -> DataFrame:
    """One row per pair: ``prompt``, ``chosen``, ``rejected`` strings and, for the
    completions, ``(start, end)`` character spans to train on. For pairs that fit
    one training example; longer ones stay in the turn form."""
    def of(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("part") == name, F.struct("turn", "rendered", "train"))))

    def spans(name: str) -> Column:
        step = lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["rendered"])).alias("at"),
            F.when(x["train"], F.concat(acc["spans"], F.array(F.struct(
                acc["at"].alias("start"), (acc["at"] + F.char_length(x["rendered"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        return F.aggregate(name, zero, step, lambda acc: acc["spans"])

    names = ("prompt", "chosen", "rejected")
    whole = parts.groupBy("pair_id").agg(*[of(n).alias(n) for n in names])
    text = lambda n: F.array_join(F.transform(n, lambda x: x["rendered"]), "").alias(n)
    return whole.select("pair_id", *[text(n) for n in names], spans("chosen").alias("chosen_train"),
                        spans("rejected").alias("rejected_train"))
