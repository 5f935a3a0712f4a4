"""Mood profiles: JSON text, label maps and score arrays in label order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_mood_scores(col) -> Column:
    """JSON text to ``map<string,double>``; missing or broken text gives an empty map."""
    empty = F.create_map().cast("map<string,double>")
    return F.coalesce(F.from_json(col, "map<string,double>"), empty)


def mood_vector(profile: Column, labels: Column) -> Column:
    """Scores in label order, absent labels as 0."""
    return F.transform(labels, lambda label: F.coalesce(F.try_element_at(profile, label), F.lit(0.0)))


def ranked_moods(scores: Column) -> Column:
    """``array<struct<score, pos>>`` best first, the earlier label winning ties."""
    tagged = F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("pos"), s.alias("score")))
    return F.array_sort(tagged)


def dominant_flag(scores: Column, pos: Column, floor=0.30, second_floor=0.40, ratio=0.85) -> Column:
    """True where the label at ``pos`` is the top mood, or a runner-up close to it."""
    ranked = ranked_moods(scores)
    first, second = F.try_element_at(ranked, F.lit(1)), F.try_element_at(ranked, F.lit(2))
    return F.coalesce(
        ((first["pos"] == pos) & (first["score"] >= floor))
        | (
            (second["pos"] == pos)
            & (second["score"] >= second_floor)
            & (second["score"] >= F.lit(ratio) * first["score"])
        ),
        F.lit(False),
    )
