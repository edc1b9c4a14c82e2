"""Whether reviewed levels support the score thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import score
from auditlake.operators.common import cut, zero_filled


def consensus(reviews: DataFrame) -> DataFrame:
    """event_id, level (its single most frequent; null on a tie), score, n. Reviews: event_id, reviewer, level, score."""
    votes = reviews.groupBy("event_id", "level").agg(F.count("*").alias("votes"), F.min("score").alias("score"))
    top = F.max("votes").over(Window.partitionBy("event_id"))
    out = votes.withColumn("top", top).groupBy("event_id").agg(
        F.sum((F.col("votes") == F.col("top")).cast("int")).alias("winners"), F.min(F.when(F.col("votes") == F.col("top"), F.col("level"))).alias("level"), F.min("score").alias("score"), F.sum("votes").alias("n")
    )
    return out.select("event_id", F.when(F.col("winners") == 1, F.col("level")).alias("level"), "score", "n")


def unequal_breakdowns(reviews: DataFrame) -> DataFrame:
    """Events whose reviewers gave different breakdowns."""
    return reviews.groupBy("event_id").agg(F.countDistinct("score_breakdown").alias("n")).filter("n > 1").select("event_id")


def pair_agreement(reviews: DataFrame) -> DataFrame:
    """Over all pairs of an event's reviews: pairs, exact and weighted sums. From counts by level, so no pair is formed."""
    votes = reviews.groupBy("event_id", "level").agg(F.count("*").alias("n"))
    a, b = votes.alias("a"), votes.alias("b")
    met = a.join(b, (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.level") <= F.col("b.level")))
    same = F.col("a.level") == F.col("b.level")
    pairs = F.when(same, F.expr("a.n * (a.n - 1) div 2")).otherwise(F.col("a.n") * F.col("b.n"))
    steps = F.abs(score.level_rank(F.col("a.level")) - score.level_rank(F.col("b.level")))
    out = met.select(pairs.alias("pairs"), same.alias("same"), steps.alias("steps"))
    return out.agg(F.sum("pairs").alias("pairs"), F.sum(F.when(F.col("same"), F.col("pairs")).otherwise(0)).alias("exact"), F.sum(F.col("pairs") * (3 - F.col("steps"))).alias("thirds"))


def histogram(events: DataFrame) -> DataFrame:
    """(score, level) -> n: at most 44 rows, whatever the input; all metrics come from it."""
    return events.filter("level is not null").groupBy("score", "level").agg(F.count("*").alias("n"))


def grid(spark) -> DataFrame:  # noqa: ANN001
    """The 120 rising threshold triples of 0 to 9."""
    spark_range = lambda n: spark.range(10).select(F.col("id").cast("int").alias(n))
    return spark_range("watch").join(spark_range("low"), F.col("watch") < F.col("low")).join(spark_range("medium"), F.col("low") < F.col("medium"))


def confusion(hist: DataFrame, predicted: Column) -> DataFrame:
    """actual, predicted, n over all 16 cells."""
    found = hist.groupBy(F.col("level").alias("actual"), predicted.alias("predicted")).agg(F.sum("n").alias("n"))
    cells = hist.sparkSession.createDataFrame([(a, b) for a in K.LEVELS for b in K.LEVELS], "actual string, predicted string")
    return cells.join(F.broadcast(found), ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def metrics(hist: DataFrame, triples: DataFrame) -> DataFrame:
    """Per triple: total, correct and macro_f1 (levels that neither occur nor are predicted count 0)."""
    rows = triples.join(F.broadcast(hist))
    predicted = score.level_with_thresholds(F.col("score"), F.col("watch"), F.col("low"), F.col("medium"))
    rows = rows.withColumn("predicted", predicted)
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    sums = [n((F.col("level") == x) & (F.col("predicted") == x)).alias(f"tp_{x}") for x in K.LEVELS]
    sums += [n(F.col("level") == x).alias(f"a_{x}") for x in K.LEVELS] + [n(F.col("predicted") == x).alias(f"p_{x}") for x in K.LEVELS]
    out = rows.groupBy("watch", "low", "medium").agg(F.sum("n").alias("total"), *sums)
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"tp_{x}"), (F.col(f"a_{x}") + F.col(f"p_{x}")).cast("double")), F.lit(0.0)) for x in K.LEVELS]
    correct = sum((F.col(f"tp_{x}") for x in K.LEVELS), F.lit(0))
    return out.select("watch", "low", "medium", "total", correct.alias("correct"), F.round((f1[0] + f1[1] + f1[2] + f1[3]) / 4, 4).alias("macro_f1"))


def grid_search(hist: DataFrame) -> DataFrame:
    """All triples with their rank: macro F1, correct, nearness to the current thresholds, the triple itself."""
    out = metrics(hist, grid(hist.sparkSession))
    w, low, m = K.THRESHOLDS
    away = F.abs(F.col("watch") - w) + F.abs(F.col("low") - low) + F.abs(F.col("medium") - m)
    order = Window.orderBy(F.desc("macro_f1"), F.desc("correct"), away, "watch", "low", "medium")
    return out.withColumn("rank", F.row_number().over(order))


def sample_gate(events: DataFrame, total: int = 20, each: int = 3) -> DataFrame:
    """Level counts with zeros, and whether they suffice."""
    found = zero_filled(events.filter("level is not null").groupBy("level").agg(F.count("*").alias("n")), "level", K.LEVELS)
    return found.agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("label_counts"), ((F.sum("n") >= total) & (F.min("n") >= each)).alias("sufficient"))


def dimension_means(events: DataFrame, dimensions: tuple[str, ...] = K.BREAKDOWN) -> DataFrame:
    """level, dimension, mean (three places); events have a column a dimension."""
    long = events.filter("level is not null").unpivot(["level"], list(dimensions), "dimension", "value")
    return long.groupBy("level", "dimension").agg(F.round(F.avg("value"), 3).alias("mean"))


def status(best: DataFrame, sufficient: bool) -> str:
    """What a calibration says: it never changes rules by itself."""
    if not sufficient:
        return "insufficient_data"
    row = best.filter("rank = 1").first()
    return "current_rules_supported" if (row["watch"], row["low"], row["medium"]) == K.THRESHOLDS else "candidate_change_requires_review"


def compare_reports(current: DataFrame, previous: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """metric, current, previous and delta of two one-row reports."""
    long = lambda df, n: df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], list(names), "metric", n)
    return long(current, "current").join(long(previous, "previous"), "metric", "full_outer").withColumn("delta", score.numeric_delta(F.col("current"), F.col("previous")))


def require_ready(ready: DataFrame) -> None:
    """Refuses an incremental worksheet (``worksheet.ready``) in which changes still wait for a review."""
    row = ready.first()
    if row is None or not row["ready"]:
        raise ValueError(f"calibration waits for {row['blockers'] if row else 'a worksheet'} unresolved records")


def calibrate(reviews: DataFrame, total: int = 20, each: int = 3) -> DataFrame:
    """One row: counts, agreement, the gate, the current thresholds' figures and, past the gate, the best candidate's.

    Reviews: event_id, reviewer, level, score. All figures come from the consensus' histogram of 44 rows and from counts
    by event and level.
    """
    if min(total, each) < 1:
        raise ValueError("minimum sample limits must be positive")
    events = consensus(reviews)
    hist = cut(histogram(events))
    ranked = grid_search(hist)
    w, low, m = K.THRESHOLDS
    shown = lambda df, name: df.select(
        F.struct("watch", "low", "medium").alias(f"{name}_thresholds"), F.round(F.try_divide(F.col("correct"), F.col("total")), 4).alias(f"{name}_accuracy"),
        F.col("macro_f1").alias(f"{name}_macro_f1"), (F.col("total") - F.col("correct")).alias(f"{name}_disagreement_count"),
    )
    current = shown(ranked.filter((F.col("watch") == w) & (F.col("low") == low) & (F.col("medium") == m)), "current")
    best = shown(ranked.filter("rank = 1"), "candidate").drop("candidate_disagreement_count")
    counted = events.agg(F.count("level").alias("consensus_event_count"), F.count_if(F.col("level").isNull()).alias("excluded_conflict_count"), F.sum("n").alias("review_record_count"))
    levels = zero_filled(hist.groupBy("level").agg(F.sum("n").alias("n")), "level", K.LEVELS)
    gate = levels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("label_counts"), ((F.sum("n") >= total) & (F.min("n") >= each)).alias("sufficient"))
    pairs = pair_agreement(reviews)
    agreed = pairs.select("pairs", F.round(F.try_divide("exact", "pairs"), 4).alias("exact_agreement"), F.round(F.try_divide(F.col("thirds") / 3, F.col("pairs")), 4).alias("weighted_agreement"))
    out = counted
    for one in (gate, agreed):
        out = out.join(F.broadcast(one))  # one row each
    for one in (current, best):
        out = out.join(F.broadcast(one), F.lit(True), "left")
    same = F.col("current_thresholds") == F.col("candidate_thresholds")
    status = F.when(~F.col("sufficient"), "insufficient_data").when(same, "current_rules_supported").otherwise("candidate_change_requires_review")
    for c in best.columns:
        out = out.withColumn(c, F.when(F.col("sufficient"), F.col(c)))
    return out.withColumn("recommendation_status", status).withColumn("automatic_rule_change_allowed", F.lit(False))


#: What decides about thresholds in a calibration.
DECISIVE = (
    "consensus_event_count", "label_counts", "current_thresholds", "current_accuracy", "current_macro_f1", "current_disagreement_count", "recommendation_status",
    "candidate_thresholds", "candidate_accuracy", "candidate_macro_f1",
)


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Whether two calibrations differ in what decides, and where: decision_relevant_change and fields."""
    told = lambda df, name: df.select(F.struct(*[(F.to_json(c) if c == "label_counts" else F.col(c)).alias(c) for c in DECISIVE]).alias(name))
    both = told(current, "c").join(F.broadcast(told(previous, "p")))
    differ = F.filter(F.array(*[F.when(~F.col(f"c.{c}").eqNullSafe(F.col(f"p.{c}")), F.lit(c)) for c in DECISIVE]), lambda x: x.isNotNull())
    return both.select(differ.alias("fields")).withColumn("decision_relevant_change", F.size("fields") > 0)


# Exit codes of an update by its status.
UPDATE_EXITS = {"calibration_complete": 0, "human_review_required": 3, "insufficient_calibration_sample": 4}


def update(ready: DataFrame, calibration: DataFrame | None, previous: DataFrame | None = None, decided: bool = False) -> dict:
    """What an update of a calibration comes to: status, exit code and who has to decide about the thresholds.

    ``ready`` is ``worksheet.ready``; ``decided`` says that a human decision on the previous calibration exists.
    """
    if not ready.first()["ready"] or calibration is None:
        status, threshold = "human_review_required", "not_evaluated"
    else:
        row = calibration.first()
        difference = changed(calibration, previous).first() if previous is not None else None
        if not row["sufficient"]:
            status, threshold = "insufficient_calibration_sample", "insufficient_data"
        else:
            kept = decided and difference is not None and not difference["decision_relevant_change"]
            supported = row["recommendation_status"] == "current_rules_supported"
            status, threshold = "calibration_complete", "current_rules_supported" if supported else "previous_human_decision_retained" if kept else "fresh_human_decision_required"
    return {"status": status, "exit_code": UPDATE_EXITS[status], "threshold_status": threshold, "automatic_threshold_change_allowed": False}
