"""Weighted rubric scores of nominations. Raw scores are an input column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions in order, their points and a question for the council (fixed values).
DIMENSIONS = (
    ("impact", 25, "Ask: Can you describe the specific outcome in more detail? Were there measurable results?"),
    ("consistency", 20, "Ask: Over what period have you observed this behavior? Can you share another example?"),
    ("collaboration", 20, "Ask: Can you name a specific colleague this person supported and describe how?"),
    ("initiative", 15, "Ask: Was this action self-initiated? What was the outcome of the initiative?"),
    ("values_alignment", 10, "Ask: Which specific organizational value does this behavior reflect and how?"),
    ("client_impact", 10, "Ask: Can you describe the direct impact on a specific client or community member?"),
)


def rubric(c: Column) -> Column:
    """Levels by lower bounds, without gaps."""
    return F.when(c >= 0.9, "exceptional").when(c >= 0.7, "strong").when(c >= 0.4, "adequate").when(c >= 0.1, "insufficient").otherwise("not_addressed")


def dimension_scores(scores: DataFrame, keys: tuple[str, ...] = ("nomination_id",)) -> DataFrame:
    """One row for each nomination and dimension: clamped, weighted, rated; a missing dimension scores 0."""
    dims = F.array(
        *(
            F.struct(F.lit(i).alias("ordinal"), F.lit(d).alias("dimension"), F.lit(p).alias("max_points")) for i,
            (d, p, _) in enumerate(DIMENSIONS)
        )
    )
    per = scores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("dimension", "raw_score"))).alias("raw"))
    out = per.select(*keys, "raw", F.explode(dims).alias("d")).select(
        *keys, "d.*",
        F.least(
            F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_element_at("raw", F.col("d.dimension")), F.lit(0.0)))
        ).alias("raw_score")
    )
    level = rubric(F.col("raw_score"))
    return out.withColumns(
        {
            "weighted_score": F.bround(F.col("raw_score") * F.col("max_points"), 1), "rubric_level": level,
            "flagged": level.isin("insufficient", "not_addressed")
        }
    )


def extremes(dims: DataFrame, keys: tuple[str, ...] = ("nomination_id",), n: int = 2) -> DataFrame:
    """Ranks from the top by share of points, ties by dimension order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.col("weighted_score") / F.col("max_points")), "ordinal")
    return dims.withColumn("rank", F.row_number().over(w)).withColumns({"strength": F.col("rank") <= n, "gap": F.col("rank") > len(DIMENSIONS) - n})


def score_cards(scores: DataFrame, keys: tuple[str, ...] = ("nomination_id",)) -> DataFrame:
    d = extremes(dimension_scores(scores, keys), keys)
    named = lambda flag, order: F.transform(
        F.sort_array(F.collect_list(F.when(F.col(flag), F.struct(order, "dimension")))), lambda x: x["dimension"]
    )
    ask = F.create_map(*(F.lit(x) for d_, _, q in DIMENSIONS for x in (d_, q)))
    focus = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("flagged") | F.col("gap"), F.struct("ordinal", "dimension")))),
        lambda x: ask[x["dimension"]]
    )
    total = F.round(F.sum(F.col("weighted_score").cast("decimal(10,1)")).cast("double"), 1)
    cards = d.groupBy(*keys).agg(
        total.alias("total_score"), F.count_if("flagged").alias("flagged_dimensions"),
        F.concat_ws(",", named("strength", "rank")).alias("strengths"), F.concat_ws(",", named("gap", "rank")).alias("gaps"),
        F.concat_ws("|", focus).alias("council_focus")
    )
    return cards.withColumn("overall_level", rubric(F.col("total_score") / 100))


def rank_nominees(cards: DataFrame) -> DataFrame:
    w = Window.partitionBy("nomination_period").orderBy(F.desc("total_score"))
    return cards.withColumn("rank", F.rank().over(w))


def nomination_summary(cards: DataFrame, council: DataFrame) -> DataFrame:
    """Ranked cards beside the council's average. council: nomination_id, council_score."""
    c = council.groupBy("nomination_id").agg(F.round(F.avg("council_score"), 2).alias("council_avg"))
    return rank_nominees(cards).join(c, "nomination_id", "left").withColumn("difference", F.round(F.col("total_score") - F.col("council_avg"), 2))


def evidence_only(nominations: DataFrame, hidden: tuple[str, ...] = ("nominee_dept", "nominator_name", "submission_time")) -> DataFrame:
    """What a scorer may see."""
    return nominations.drop(*hidden)


def evidence_features(df: DataFrame, text: str) -> DataFrame:
    """Plain signals of a response: blank, sentences, numbers, durations or frequencies."""
    t = F.coalesce(F.col(text), F.lit(""))
    sentences = F.regexp_count(t, F.lit(r"[.!?]+(\s|$)"))
    return df.withColumns(
        {
            "is_blank": F.trim(t) == "", "sentences": sentences, "is_short": sentences < 2, "has_number": t.rlike("[0-9]"),
            "has_duration": F.lower(t).rlike(r"\b(day|week|month|year|hour)s?\b"),
            "has_frequency": F.lower(t).rlike(r"\b(always|every|daily|weekly|often|consistently)\b")
        }
    )
