"""Consensus of several annotators, by iteratively reweighted voting.

Each round sums the annotators' weights by item and answer; asks for every vote how probable its answer is by the
*other* votes of the item alone (leave one out: a softmax of their sums); smooths the mean per annotator and turns it
into the new log-odds weight. An annotator who is right less often than chance gets a negative weight: the vote then
counts against its answer. Votes of one item meet only in sums, never in one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.columns import tidy
from turnloom.runtime import drop, spill

#: The answers, in natural order.
ACTIONS = ["ack", "repair", "respond", "wait"]
#: The share of an answer among the others is a sharpened softmax, close to asking for their winner: with a plain softmax
#: the weights of a weak crowd would all sink to chance. After some rounds a part of the old weight stays, against cycles.
SHARPNESS, FREE_ROUNDS, KEPT = 8.0, 3, 0.3


def last_ratable_answers(answers: DataFrame, assignments: DataFrame) -> DataFrame:
    """(item, annotator, answer) of each original assignment by its last answer; unratable ones abstain.

    Answers to assignments that are not in the map, and repeats (``is_repeat``), don't count. The map says who was
    asked. Answers are trimmed and lower-cased; anything but the known actions, an unset ``ratable`` and a last answer
    that is unratable are abstentions. Of answers at the same time the greatest action stands. Repeated rows count once.
    """
    action = tidy("action")
    given = F.when(F.coalesce(F.col("ratable"), F.lit(False)) & action.isin(ACTIONS), action)
    last = answers.select("assignment_id", "submitted_at", given.alias("answer")).where("assignment_id is not null")
    last = last.groupBy("assignment_id").agg(F.max(F.struct("submitted_at", "answer")).alias("last"))
    asked = assignments.where("not is_repeat and assignment_id is not null").select("assignment_id", F.col("item_id").alias("item"), F.col("annotator_id").alias("annotator")).distinct()
    votes = asked.join(last, "assignment_id").select("item", "annotator", F.col("last.answer").alias("answer"))
    return votes.dropna()


def _score(answers: list[str]) -> list[Column]:
    return [F.sum(F.when(F.col("answer") == a, F.col("weight"))).alias(f"s_{i}") for i, a in enumerate(answers)]


def reweighted_votes(
    votes: DataFrame, answers: list[str] = ACTIONS, rounds: int = 50, tolerance: float = 2e-3, smoothing: float = 1.0, floor: float = 0.02
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weighted consensus, annotator reliability and the votes they rest on.

    ``votes`` has item, annotator, answer (extra columns are ignored); a pair of item and annotator counts once, by its
    greatest answer. Returns (consensus: item, n_annotators, answer, score, margin; annotators: annotator, n_votes,
    n_scored, accuracy, weight; votes). Accuracy is (agreed + smoothing) / (scored + len(answers) * smoothing) over
    items that somebody else also answered; the weight is log(accuracy * (k - 1) / (1 - accuracy)) with the accuracy
    kept ``floor`` away from 0 and 1. The consensus is one of the answers given to the item, ties go to the later one in
    the list; the margin is its score over the best of the others (0 for those not given). Rounds end once no weight moves by more
    than ``tolerance``; weights that still move after ``rounds`` are an error. No votes give empty results.
    """
    k = len(answers)
    votes = votes.select("item", "annotator", "answer").where(F.col("answer").isin(answers)).dropna()
    votes = spill(votes.groupBy("item", "annotator").agg(F.max("answer").alias("answer")), "votes")
    trust = votes.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_votes"), F.lit(0).cast("bigint").alias("n_scored"), F.lit(0.0).alias("accuracy"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("moved"))
    trust = spill(trust, "trust")
    moved = None
    for turn in range(rounds):
        weighted = votes.join(trust.select("annotator", "weight"), "annotator")
        totals = weighted.groupBy("item").agg(*_score(answers), F.count(F.lit(1)).alias("n"))
        own = [F.col("answer") == a for a in answers]
        rest = [F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) - F.when(o, F.col("weight")).otherwise(0.0) for i, o in enumerate(own)]
        others = [F.exp((r - F.greatest(*rest)) * SHARPNESS) for r in rest]  # below 1, so that a thousand votes don't overflow
        mine = sum((F.when(o, e).otherwise(0.0) for o, e in zip(own, others, strict=True)), F.lit(0.0))
        agreed = F.when(F.col("n") > 1, mine / sum(others[1:], others[0]))  # null if nobody else answered
        scored = weighted.join(totals.where("n > 1"), "item", "left").groupBy("annotator").agg(F.count(F.lit(1)).alias("n_votes"), F.count(agreed).alias("n_scored"), F.coalesce(F.sum(agreed), F.lit(0.0)).alias("agreed"))
        accuracy = (F.col("agreed") + smoothing) / (F.col("n_scored") + k * smoothing)
        held = F.least(F.greatest(accuracy, F.lit(floor)), F.lit(1 - floor))
        new = scored.select("annotator", "n_votes", "n_scored", accuracy.alias("accuracy"), F.log(held * (k - 1) / (1 - held)).alias("full"))
        kept = KEPT if turn >= FREE_ROUNDS else 0.0
        new = new.join(trust.select("annotator", F.col("weight").alias("old")), "annotator").withColumn("weight", kept * F.col("old") + (1 - kept) * F.col("full"))
        new = spill(new.withColumn("moved", F.abs(F.col("weight") - F.col("old"))).drop("old", "full"), "trust")
        moved = new.agg(F.max("moved")).first()[0]
        drop(trust)
        trust = new
        if moved is None or moved <= tolerance:
            break
    else:
        raise RuntimeError(f"weights still move by {moved} after {rounds} rounds")
    totals = votes.join(trust.select("annotator", "weight"), "annotator").groupBy("item").agg(*_score(answers), F.count(F.lit(1)).alias("n_annotators"))
    scores = [F.col(f"s_{i}") for i in range(k)]
    given = F.filter(F.array(*[F.struct(s.alias("s"), F.lit(a).alias("a")) for s, a in zip(scores, answers, strict=True)]), lambda o: o.s.isNotNull())
    best = totals.withColumn("best", F.array_max(given))
    rest = F.filter(F.array(*[F.struct(F.coalesce(s, F.lit(0.0)).alias("s"), F.lit(a).alias("a")) for s, a in zip(scores, answers, strict=True)]), lambda o: o.a != F.col("best.a"))
    consensus = best.select("item", "n_annotators", F.col("best.a").alias("answer"), F.col("best.s").alias("score"), (F.col("best.s") - F.array_max(rest).s).alias("margin"))
    return consensus, trust, votes


def last_details(answers: DataFrame, assignments: DataFrame) -> DataFrame:
    """(item, annotator, confidence, alternates) of each original assignment by its last answer.

    Confidence outside 1 to 5 is null; alternates are trimmed, lower-cased and of the known actions, null alternates are none.
    """
    tidied = F.transform(F.coalesce("also_acceptable", F.array().cast("array<string>")), lambda a: tidy(a))
    alternates = F.array_distinct(F.filter(tidied, lambda a: a.isin(ACTIONS)))
    last = answers.where("assignment_id is not null").groupBy("assignment_id").agg(F.max_by(F.struct(F.when(F.col("confidence").between(1, 5), F.col("confidence")).alias("confidence"), alternates.alias("alternates")), F.struct("submitted_at", tidy("action"))).alias("d"))
    asked = assignments.where("not is_repeat and assignment_id is not null").select("assignment_id", F.col("item_id").alias("item"), F.col("annotator_id").alias("annotator")).distinct()
    return asked.join(last, "assignment_id").select("item", "annotator", "d.confidence", "d.alternates")


def calibration(consensus: DataFrame, votes: DataFrame, details: DataFrame) -> DataFrame:
    """Per annotator: how often the answer is the consensus, how often the consensus is at least among the alternates, and the mean
    confidence of both kinds of answers (null where there are none). These don't weigh a vote; they tell what it is worth.
    """
    d = details.groupBy("item", "annotator").agg(F.max("confidence").alias("confidence"), F.max("alternates").alias("alternates"))
    j = votes.join(consensus.select("item", F.col("answer").alias("best")), "item").join(d, ["item", "annotator"], "left")
    agrees = F.col("answer") == F.col("best")
    near = ~agrees & F.coalesce(F.array_contains("alternates", F.col("best")), F.lit(False))
    return j.groupBy("annotator").agg(
        F.avg(agrees.cast("double")).alias("agreed"), F.avg(near.cast("double")).alias("acceptable"), F.avg(F.when(agrees, F.col("confidence"))).alias("confidence_agreed"), F.avg(F.when(~agrees, F.col("confidence"))).alias("confidence_differed")
    )


def alpha(votes: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Krippendorff's nominal alpha for any number of ratings per item: chance-corrected, missing ratings allowed.

    Items with fewer than two ratings don't count. Columns: the groups, ``n_items``, ``n_ratings``, ``alpha`` (null if
    there are fewer than two ratings or only one answer occurs).
    """
    groups = groups or []
    counts = votes.where("answer is not null and item is not null").groupBy(*groups, "item", "answer").agg(F.count(F.lit(1)).alias("n"))
    items = counts.groupBy(*groups, "item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("m >= 2")
    observed = items.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n_ratings"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("disagreed"))
    shares = counts.join(items.select(*groups, "item"), [*groups, "item"]).groupBy(*groups, "answer").agg(F.sum("n").alias("n"))
    expected = shares.groupBy(*groups).agg(F.sum(F.col("n") * F.col("n")).alias("squares"))
    joined = observed.join(expected, groups) if groups else observed.crossJoin(expected)  # one row each
    total = F.col("n_ratings")
    value = 1 - F.try_divide(F.col("disagreed") * (total - 1), total * total - F.col("squares"))
    return joined.select(*groups, "n_items", "n_ratings", F.when(total >= 2, value).alias("alpha"))
