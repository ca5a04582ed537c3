"""Question and answer pairs, preference pairs, and the transcripts they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contrail.operators.spread import dense_ids

# fixed values: sounds that say nothing
FILLERS = ("um", "uh", "uhm", "erm", "hmm", "um,", "uh,", "uhm,", "erm,", "hmm,")


def _tidy(line: Column) -> Column:
    """A line without fillers and repeated blanks."""
    spoken = F.filter(F.split(line, "[ \\t\\r]+"), lambda w: (w != "") & ~F.lower(w).isin(*FILLERS))
    return F.array_join(spoken, " ")


def clean_transcripts(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) in plain lines: no fillers, no empty line, no line twice."""
    lines = F.filter(F.transform(F.split("text", "\n"), _tidy), lambda line: line != "")
    return turns.select("conv_id", "turn", "role", F.array_join(F.array_distinct(lines), "\n").alias("text"))


def answer_pairs(turns: DataFrame, least_words: int = 1, most_words: int | None = None) -> DataFrame:
    """Each user turn with the assistant turn right behind it; equal pairs once.

    Turns of less than ``least_words`` or, where it is given, more than ``most_words`` make no pair. Of
    equal pairs the one with the smallest conversation and turn stays.
    """
    words = F.size(F.split("text", "\\s+"))
    fit = turns.filter((F.length("text") > 0) & (words >= least_words))
    if most_words is not None:
        fit = fit.filter(words <= most_words)
    asked = fit.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    told = fit.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    pairs = asked.join(told, ["conv_id", "turn"])
    first = pairs.groupBy("prompt", "response").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    return first.select("at.conv_id", "at.turn", "prompt", "response")


def preference_pairs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Good texts paired with bad ones of the same language, both in the order of their ids.

    The n-th good and the n-th bad text of a language make a pair. Ranks come from
    ids dealt over range partitions, so a language of any size has no window of its own.
    """
    judged = documents.join(labels.filter("quality IN (0, 1)").select("doc_id", "quality"), "doc_id")
    ids = judged.select("lang", "quality", "doc_id")
    dealt = dense_ids(ids, ["lang", "quality", "doc_id"], "place")
    first = dealt.groupBy("lang", "quality").agg(F.min("place").alias("first"))
    ranked = dealt.join(first, ["lang", "quality"]).select(
        "lang", "quality", "doc_id", (F.col("place") - F.col("first") + 1).alias("pair_no")
    )
    side = lambda quality, name: ranked.filter(F.col("quality") == quality).select(
        "lang", "pair_no", F.col("doc_id").alias(f"{name}_id")
    )
    pairs = side(1, "chosen").join(side(0, "rejected"), ["lang", "pair_no"])
    text = lambda name: documents.select(F.col("doc_id").alias(f"{name}_id"), F.col("text").alias(name))
    told = pairs.join(text("chosen"), "chosen_id").join(text("rejected"), "rejected_id")
    return told.select("lang", "pair_no", "chosen_id", "rejected_id", "chosen", "rejected")
