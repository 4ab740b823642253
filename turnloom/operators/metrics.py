"""Ranking and class metrics of scored frames, per group.

All ranking metrics come from one ranked table, made by two-level running sums, so a group of any size is spread over
buckets of its score. Groups with one class give null where the measure is undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.running import running

STEP = 0.01


def counts(df: DataFrame, groups: list[str], y: str = "y") -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(y).alias("n_pos"), F.sum(1 - F.col(y)).alias("n_neg"))


def by_score(df: DataFrame, groups: list[str], y: str = "y", score: str = "score", step: float = STEP) -> DataFrame:
    """One row per group and distinct score: positives and negatives there, and (tp, fp) at or above it."""
    per = df.groupBy(*groups, F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    return running(per, groups, F.floor(-F.col("score") / step), [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})


def auroc(df: DataFrame, groups: list[str], y: str = "y", score: str = "score", step: float = STEP) -> DataFrame:
    """P(positive above negative) + half of P(tie); null if a class is missing."""
    s = by_score(df, groups, y, score, step)
    good = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))  # positives above each negative
    a = s.groupBy(*groups).agg(good.alias("_good"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return a.withColumn("auroc", F.try_divide("_good", F.col("n_pos") * F.col("n_neg"))).drop("_good")


def ranked(df: DataFrame, groups: list[str], tie: list[str], y: str = "y", score: str = "score", step: float = STEP) -> DataFrame:
    """Rows with rank ``rn`` from the highest score down and ``hits`` among the first rn; ties in the order of ``tie``."""
    return running(df, groups, F.floor(-F.col(score) / step), [F.desc(score), *tie], {"rn": F.lit(1), "hits": F.col(y)})


def average_precision(df: DataFrame, groups: list[str], tie: list[str], y: str = "y", score: str = "score", step: float = STEP) -> DataFrame:
    """Mean precision at the positives; null if there is no positive or nothing else."""
    r = ranked(df, groups, tie, y, score, step)
    hit = F.col(y) == 1
    g = r.groupBy(*groups).agg(F.avg(F.when(hit, F.col("hits") / F.col("rn"))).alias("_ap"), F.sum(y).alias("_p"), F.count(F.lit(1)).alias("_n"))
    return g.select(*groups, F.when((F.col("_p") > 0) & (F.col("_p") < F.col("_n")), F.col("_ap")).alias("ap"))


def at_threshold(df: DataFrame, groups: list[str], threshold: float, y: str = "y", score: str = "score") -> DataFrame:
    """Precision, recall and F1 of score >= threshold; each null where its denominator is 0."""
    above = F.col(score) >= threshold
    g = df.groupBy(*groups).agg(F.count(F.when(above & (F.col(y) == 1), 1)).alias("tp"), F.count(F.when(above & (F.col(y) == 0), 1)).alias("fp"), F.count(F.when(~above & (F.col(y) == 1), 1)).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    g = g.withColumn("precision", p).withColumn("recall", r)
    return g.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_f1(df: DataFrame, groups: list[str], y: str = "y", score: str = "score", step: float = STEP) -> DataFrame:
    """Threshold of the best F1 (the highest of equal ones) and the values there; null if a class is missing."""
    s = by_score(df, groups, y, score, step)
    totals = s.groupBy(*groups).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    j = s.join(totals, groups) if groups else s.crossJoin(totals)
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p"))
    j = j.where("p > 0 and n > 0 and tp > 0")
    best = j.groupBy(*groups).agg(F.max(F.struct(f1.alias("f1"), F.col("score").alias("thr"), "tp", "fp", "p")).alias("b"))
    best = best.select(*groups, F.col("b.thr").alias("threshold"), (F.col("b.tp") / (F.col("b.tp") + F.col("b.fp"))).alias("precision"), (F.col("b.tp") / F.col("b.p")).alias("recall"), F.col("b.f1").alias("f1"))
    return totals.select(*groups).join(best, groups, "left") if groups else best


def precision_at_recall(df: DataFrame, groups: list[str], tie: list[str], recall: float, y: str = "y", score: str = "score", step: float = STEP) -> DataFrame:
    """Highest precision over prefixes of the ranking whose recall reaches the target; null without positives."""
    if not 0 < recall <= 1:
        raise ValueError("recall must be in (0, 1]")
    r = ranked(df, groups, tie, y, score, step)
    totals = df.groupBy(*groups).agg(F.sum(y).alias("_p"))
    j = r.join(totals, groups) if groups else r.crossJoin(totals)
    ok = (F.col("_p") > 0) & (F.col("hits") >= recall * F.col("_p"))
    return j.groupBy(*groups).agg(F.max(F.when(ok, F.col("hits") / F.col("rn"))).alias("precision_at_recall"))


def unpivoted(df: DataFrame, groups: list[str], each: list[dict[str, Column]]) -> DataFrame:
    """A row per item of ``each`` with its number ``which``."""
    rows = F.array(*[F.struct(F.lit(i).alias("which"), *[c.alias(n) for n, c in values.items()]) for i, values in enumerate(each)])
    return df.select(*groups, F.explode(rows).alias("_e")).select(*groups, "_e.*")


def counts_each(df: DataFrame, groups: list[str], ys: list[str]) -> DataFrame:
    """Like ``counts`` for several label columns at once (null: the row doesn't count for it); columns without rows are left out."""
    g = df.groupBy(*groups).agg(*[F.count(y).alias(f"_n{i}") for i, y in enumerate(ys)], *[F.sum(y).alias(f"_p{i}") for i, y in enumerate(ys)])
    out = unpivoted(g, groups, [{"n_chunks": F.col(f"_n{i}"), "n_pos": F.col(f"_p{i}"), "n_neg": F.col(f"_n{i}") - F.col(f"_p{i}")} for i in range(len(ys))])
    return out.where("n_chunks > 0")


def by_score_each(df: DataFrame, groups: list[str], ys: list[str], score: str = "score", step: float = STEP) -> DataFrame:
    """One row per group and distinct score: positives ``p0``, ... and rows ``n0``, ... there, and at or above it ``tp0``, ..., ``tn0``, ...

    The scores are sorted once for all label columns.
    """
    every = [f(y).cast("bigint").alias(f"{c}{i}") for c, f in (("p", F.sum), ("n", F.count)) for i, y in enumerate(ys)]
    per = df.groupBy(*groups, F.col(score).alias("score")).agg(*every)
    sums = {f"t{c}{i}": F.coalesce(f"{c}{i}", F.lit(0)) for c in "pn" for i in range(len(ys))}
    return running(per, groups, F.floor(-F.col("score") / step), [F.desc("score")], sums)


def auroc_each(df: DataFrame, groups: list[str], ys: list[str], score: str = "score", step: float = STEP) -> DataFrame:
    s = by_score_each(df, groups, ys, score, step)
    sums = []
    for i in range(len(ys)):
        pos, neg = F.coalesce(f"p{i}", F.lit(0)), F.col(f"n{i}") - F.coalesce(f"p{i}", F.lit(0))
        sums += [F.sum(neg * (F.col(f"tp{i}") - pos + pos / 2.0)).alias(f"_good{i}"), F.sum(pos).alias(f"_pos{i}"), F.sum(neg).alias(f"_neg{i}")]
    out = unpivoted(s.groupBy(*groups).agg(*sums), groups, [{"n_pos": F.col(f"_pos{i}"), "n_neg": F.col(f"_neg{i}"), "auroc": F.try_divide(f"_good{i}", F.col(f"_pos{i}") * F.col(f"_neg{i}"))} for i in range(len(ys))])
    return out.where("n_pos + n_neg > 0")


def ranked_each(df: DataFrame, groups: list[str], tie: list[str], ys: list[str], score: str = "score", step: float = STEP) -> DataFrame:
    """Adds rank ``rn0``, ... and hits ``hits0``, ... among the rows that count for each label column, from the highest score down."""
    sums = {f"rn{i}": F.col(y).isNotNull().cast("int") for i, y in enumerate(ys)} | {f"hits{i}": F.coalesce(y, F.lit(0)) for i, y in enumerate(ys)}
    return running(df, groups, F.floor(-F.col(score) / step), [F.desc(score), *tie], sums)


def average_precision_each(df: DataFrame, groups: list[str], tie: list[str], ys: list[str], score: str = "score", step: float = STEP) -> DataFrame:
    r = ranked_each(df, groups, tie, ys, score, step)
    sums = []
    for i, y in enumerate(ys):
        sums += [F.avg(F.when(F.col(y) == 1, F.col(f"hits{i}") / F.col(f"rn{i}"))).alias(f"_ap{i}"), F.sum(y).alias(f"_p{i}"), F.count(y).alias(f"_n{i}")]
    out = unpivoted(r.groupBy(*groups).agg(*sums), groups, [{"_n": F.col(f"_n{i}"), "ap": F.when((F.col(f"_p{i}") > 0) & (F.col(f"_p{i}") < F.col(f"_n{i}")), F.col(f"_ap{i}"))} for i in range(len(ys))])
    return out.where("_n > 0").drop("_n")


def precision_at_recall_each(df: DataFrame, groups: list[str], tie: list[str], recall: float, ys: list[str], score: str = "score", step: float = STEP) -> DataFrame:
    if not 0 < recall <= 1:
        raise ValueError("recall must be in (0, 1]")
    r = ranked_each(df, groups, tie, ys, score, step)
    totals = df.groupBy(*groups).agg(*[F.sum(y).alias(f"_p{i}") for i, y in enumerate(ys)], *[F.count(y).alias(f"_n{i}") for i, y in enumerate(ys)])
    j = r.join(totals, groups) if groups else r.crossJoin(totals)  # one row a group
    best = [F.max(F.when((F.col(f"_p{i}") > 0) & F.col(y).isNotNull() & (F.col(f"hits{i}") >= recall * F.col(f"_p{i}")), F.col(f"hits{i}") / F.col(f"rn{i}"))).alias(f"_b{i}") for i, y in enumerate(ys)]
    g = j.groupBy(*groups).agg(*best, *[F.first(f"_n{i}").alias(f"_n{i}") for i in range(len(ys))])
    return unpivoted(g, groups, [{"_n": F.col(f"_n{i}"), "precision_at_recall": F.col(f"_b{i}")} for i in range(len(ys))]).where("_n > 0").drop("_n")


def at_threshold_each(df: DataFrame, groups: list[str], threshold: float, ys: list[str], score: str = "score") -> DataFrame:
    above = F.col(score) >= threshold
    n = lambda c: F.count(F.when(c, 1))
    sums = [x for i, y in enumerate(ys) for x in (n(above & (F.col(y) == 1)).alias(f"_tp{i}"), n(above & (F.col(y) == 0)).alias(f"_fp{i}"), n(~above & (F.col(y) == 1)).alias(f"_fn{i}"), F.count(y).alias(f"_n{i}"))]
    out = unpivoted(df.groupBy(*groups).agg(*sums), groups, [{"tp": F.col(f"_tp{i}"), "fp": F.col(f"_fp{i}"), "fn": F.col(f"_fn{i}"), "_n": F.col(f"_n{i}")} for i in range(len(ys))]).where("_n > 0").drop("_n")
    out = out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_f1_each(df: DataFrame, groups: list[str], ys: list[str], score: str = "score", step: float = STEP) -> DataFrame:
    """Like ``best_f1``; label columns without both classes have no row here."""
    s = by_score_each(df, groups, ys, score, step)
    totals = df.groupBy(*groups).agg(*[F.sum(y).alias(f"_p{i}") for i, y in enumerate(ys)], *[F.count(y).alias(f"_n{i}") for i, y in enumerate(ys)])
    j = s.join(totals, groups) if groups else s.crossJoin(totals)  # one row a group
    best = []
    for i in range(len(ys)):
        tp, n, p = F.col(f"tp{i}"), F.col(f"tn{i}"), F.col(f"_p{i}")
        ok = (p > 0) & (p < F.col(f"_n{i}")) & (tp > 0) & (F.col(f"n{i}") > 0)
        best.append(F.max(F.when(ok, F.struct((2.0 * tp / (n + p)).alias("f1"), F.col("score").alias("threshold"), (tp / n).alias("precision"), (tp / p).alias("recall")))).alias(f"_b{i}"))
    return unpivoted(j.groupBy(*groups).agg(*best), groups, [{"b": F.col(f"_b{i}")} for i in range(len(ys))]).where("b is not null").select(*groups, "which", "b.threshold", "b.precision", "b.recall", "b.f1")


def multiclass(df: DataFrame, classes: list[str], groups: list[str], tie: list[str], truth: str = "action", p: str = "p", floor: float = 1e-12) -> DataFrame:
    """Macro average precision (null unless every class has one), accuracy (first largest wins), clipped NLL.

    ``p`` is an array of probabilities in the order of ``classes``.
    """
    each = df.select(*groups, *tie, F.col(truth).alias("_truth"), F.posexplode(p).alias("_c", "score")).withColumn("y", (F.col("_truth") == F.get(F.array(*[F.lit(c) for c in classes]), F.col("_c"))).cast("int"))
    ap = average_precision(each, [*groups, "_c"], tie)
    macro = ap.groupBy(*groups).agg(F.when(F.count("ap") == len(classes), F.avg("ap")).alias("macro_auprc"))
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(truth)) - 1
    own = F.least(F.greatest(F.get(F.col(p), at.cast("int")), F.lit(floor)), F.lit(1.0))
    right = (F.array_position(F.col(p), F.array_max(F.col(p))) - 1 == at).cast("double")
    rest = df.groupBy(*groups).agg(F.avg(right).alias("accuracy"), F.avg(-F.log(own)).alias("nll"))
    return macro.join(rest, groups) if groups else macro.crossJoin(rest)


def bce_with_logits(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def masses(df: DataFrame, groups: list[str], user: str = "user", assistant: str = "assistant") -> DataFrame:
    """Shares of frames: assistant speaks, over the user, without the user, and nobody speaks."""
    a, u = F.col(assistant), F.col(user)
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*groups).agg(share(a).alias("speak"), share(a & u).alias("overlap"), share(a & ~u).alias("gap"), share(~a & ~u).alias("mutual_silence"), F.count(F.lit(1)).alias("n_frames"))


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float], step: float = STEP) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group; rows without a value are left out.

    From ranks by two-level running sums over distinct values: no buffer holds the values of a group.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = running(per, groups, F.floor(F.col("_v") / step), ["_v"], {"_cum": F.col("_c")})
    totals = per.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    j = upto.join(totals, groups) if groups else upto.crossJoin(totals)  # one row a group
    aggs = []
    for name, q in shares.items():
        at = (F.col("_n") - 1) * q
        aggs += [F.min(F.when(F.col("_cum") >= F.floor(at) + 1, F.col("_v"))).alias(f"_lo_{name}"), F.min(F.when(F.col("_cum") >= F.ceil(at) + 1, F.col("_v"))).alias(f"_hi_{name}"), F.max(at - F.floor(at)).alias(f"_f_{name}")]
    return j.groupBy(*groups).agg(*aggs).select(*groups, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in shares])


def robust_threshold(df: DataFrame, groups: list[str], value: str = "value", spread: float = 3.0, flat: float = 1e-12) -> DataFrame:
    """median + spread * MAD per group; where the MAD vanishes the 80th percentile, kept above the median."""
    mid = quantiles(df, groups, value, {"median": 0.5, "p80": 0.8})
    dev = quantiles(df.join(mid, groups).withColumn("_d", F.abs(F.col(value) - F.col("median"))), groups, "_d", {"mad": 0.5})
    return mid.join(dev, groups).withColumn("threshold", F.when(F.col("mad") < flat, F.greatest(F.col("p80"), F.col("median") + flat)).otherwise(F.col("median") + spread * F.col("mad")))


def silence_runs(long_runs: DataFrame, groups: list[str]) -> DataFrame:
    """Summary of silent runs (n_frames, mean, var per run): number, mean variance, and whether one has collapsed."""
    flat = (F.col("var") < 1e-8) | ((F.col("mean") < 1e-4) & (F.sqrt("var") < 1e-6))
    return long_runs.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_long_runs"), F.avg("var").alias("long_var_mean"), F.max(flat).alias("collapsed"))
