"""The comparison of several signals as predictors of turn events, from cleaned tables to a report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.columns import EVENT_KINDS
from turnloom.operators import labels as lb
from turnloom.operators import metrics as mt
from turnloom.operators import resample as rs
from turnloom.operators import timeline as tl
from turnloom.runtime import drop, spill


@dataclass
class Compare:
    """What is compared: signals, kinds, horizons, window, whether signals are cut to common frames, replicates."""

    signals: list[str]
    kinds: list[str] = field(default_factory=lambda: list(EVENT_KINDS))
    horizons_ms: list[int] = field(default_factory=lambda: [500, 1000, 2000])
    window_ms: int | None = None
    mode: str = "mid"
    common: bool = True
    replicates: int = 200
    seed: int = 20260903

    def __post_init__(self) -> None:
        if not self.signals or not self.kinds or not self.horizons_ms or min(self.horizons_ms) <= 0:
            raise ValueError("signals, kinds and positive horizons are needed")


#: Most pairs that are compared one after another. More is an error, not a cut.
MAX_PAIRS = 100


def pairs(frames: DataFrame) -> list[tuple[str, str]]:
    """Every two signals that some session has both of, sorted."""
    s = frames.select("session_id", F.col("signal_name").alias("a")).distinct()
    found = s.join(s.withColumnRenamed("a", "b"), "session_id").where("a < b").select("a", "b").distinct().limit(MAX_PAIRS + 1).collect()
    if len(found) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of signals")
    return sorted((r["a"], r["b"]) for r in found)


GROUPS = ["session_id", "signal_name", "kind", "horizon_ms"]


def labelled(frames: DataFrame, events: DataFrame, durations: DataFrame, what: Compare) -> DataFrame:
    """Frames of the signals (cropped, cut to common frames) with a label column for each kind and horizon."""
    f = frames.where(F.col("signal_name").isin(what.signals)).select("session_id", "signal_name", "frame", "value").join(durations, "session_id")
    if what.window_ms:
        f = tl.crop(f, what.window_ms, what.mode).withColumn("duration_ms", F.lit(what.window_ms).cast("bigint"))
    if what.common:
        f = tl.align(f, what.signals)
    f = f.withColumn("t_end_ms", (F.col("frame") + 1) * tl.FRAME_MS)
    return lb.horizon_flags(f, events, what.kinds, what.horizons_ms)


def rows(frames: DataFrame, events: DataFrame, durations: DataFrame, what: Compare) -> DataFrame:
    """One row per session, signal, kind and horizon: counts, AUROC, average precision, best F1."""
    ys = [f"y{i}" for i in range(len(what.kinds) * len(what.horizons_ms))]
    by = GROUPS[:2]
    scored = labelled(frames, events, durations, what).select(*by, "frame", *ys, F.col("value").alias("score"))
    scored = spill(scored, "scored")  # three measures read it
    a = mt.auroc_each(scored, by, ys)
    p = mt.average_precision_each(scored, by, ["frame"], ys)
    b = mt.best_f1_each(scored, by, ys).select(*by, "which", F.col("f1").alias("best_f1"), F.col("threshold").alias("best_threshold"))
    joined = lb.named_flags(a.join(p, [*by, "which"]).join(b, [*by, "which"], "left"), what.kinds, what.horizons_ms)
    out = spill(joined.select(*GROUPS, "n_pos", "n_neg", "auroc", "ap", "best_f1", "best_threshold"), "compared")  # the summary reads it four times
    drop(scored)
    return out


def summary(per_session: DataFrame, what: Compare) -> DataFrame:
    """Means over sessions with a value, and the percentile interval over resampled sessions."""
    keys = GROUPS[1:]
    defined = per_session.where("auroc is not null").select("session_id", *keys, F.col("auroc").alias("vw"), F.lit(1.0).alias("w"), "ap")
    ci = rs.interval(rs.bootstrap(defined, "session_id", ["vw", "w"], rs.weighted_mean(), what.replicates, what.seed, keys), keys)
    means = defined.groupBy(*keys).agg(F.avg("vw").alias("auroc"), F.avg("ap").alias("ap"), F.count(F.lit(1)).alias("n_sessions"))
    interval = F.when(F.col("n_sessions") > 1, F.struct("lo", "hi"))
    return means.join(ci, keys, "left").select(*keys, "auroc", "ap", "n_sessions", interval.alias("auroc_ci"))


# All pairs at once. Labels of a frame don't depend on the pair and pairs only choose frames, so the frames are shuffled
# twice however many pairs there are: by time for the labels, by score for the ranking.

#: Points of a series that one task may rank whole; longer series are ranked in buckets of the score.
WHOLE = 100_000


def flagged(points: DataFrame, events: DataFrame, ends: DataFrame, signals: list[str], what: Compare) -> DataFrame:
    """A row per session and frame: the signals' values ``s0``, ..., bits ``y`` of its labels and ``ok`` of the horizons it sees.

    ``points``: session_id, signal_name, frame, value, repeats allowed (the greatest value counts); ``ends``: session_id,
    duration_ms. The labels are those of ``labels.horizon_flags``, bit kind * horizons + horizon.
    """
    n, reach = len(what.horizons_ms), max(what.horizons_ms) + 1
    asked = points.select("session_id", F.floor((F.col("frame") + 1) * tl.FRAME_MS / lb.SLICE_MS).alias("slot"), ((F.col("frame") + 1) * tl.FRAME_MS).alias("at"), "signal_name", "value")
    marks = events.select("session_id", "kind", "t_ms").unionByName(ends.select("session_id", F.lit("\x00end").alias("kind"), (F.col("duration_ms") + 1).alias("t_ms")))
    told = marks.where("session_id is not null and t_ms is not null").select(
        "session_id", F.explode(F.sequence(F.floor((F.col("t_ms") - reach) / lb.SLICE_MS), F.floor((F.col("t_ms") - 1) / lb.SLICE_MS))).alias("slot"), F.col("t_ms").alias("at"), "kind"
    )
    both = asked.unionByName(told, allowMissingColumns=True).repartition("session_id", "slot")
    values = [F.max(F.when(F.col("signal_name") == x, F.col("value"))).alias(f"s{i}") for i, x in enumerate(signals)]
    kinds = [*what.kinds, "\x00end"]
    told_of = [F.max(F.when(F.col("kind") == k, F.col("at"))).alias(f"_t{i}") for i, k in enumerate(kinds)]
    each = both.groupBy("session_id", "slot", "at").agg(F.count("signal_name").alias("_points"), *values, *told_of)
    w = Window.partitionBy("session_id", "slot").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    seen = each.select("session_id", "at", "_points", *[f"s{i}" for i in range(len(signals))], *[F.min(f"_t{i}").over(w).alias(f"_e{i}") for i in range(len(kinds))]).where("_points > 0")
    end = F.col(f"_e{len(what.kinds)}")
    inside = [F.coalesce(F.col("at") + h < end, F.lit(True)) for h in what.horizons_ms]
    bits = lambda flags: sum((F.when(c, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, c in enumerate(flags)), F.lit(0).cast("bigint"))
    ys = [inside[j] & (F.col(f"_e{i}") <= F.col("at") + what.horizons_ms[j]) for i in range(len(what.kinds)) for j in range(n)]
    return seen.select("session_id", F.expr(f"at div {tl.FRAME_MS} - 1").alias("frame"), *[f"s{i}" for i in range(len(signals))], bits(ys).alias("y"), bits(inside).alias("ok"))


def _bit(c: str, i: int) -> Column:
    return F.shiftright(c, i).bitwiseAND(F.lit(1))


def ranked_pairs(flags: DataFrame, found: list[tuple[str, str]], signals: list[str], long: DataFrame, what: Compare) -> DataFrame:
    """AUROC and average precision per pair, session, signal, kind and horizon, on the frames the pair has in common; only where both classes are there.

    ``long``: session_id of the sessions whose series are ranked in buckets. Scores are sorted once for both measures and
    all labels. Positives above negatives are counted from both sides, so ties count half without a row per score.
    """
    n, m = len(what.horizons_ms), len(what.kinds) * len(what.horizons_ms)
    at = {x: f"s{i}" for i, x in enumerate(signals)}
    sides = [F.when(F.col(at[a]).isNotNull() & F.col(at[b]).isNotNull(), F.struct(F.lit(p).alias("p"), F.lit(x == b).alias("second"), F.col(at[x]).alias("score"))) for p, (a, b) in enumerate(found) for x in (a, b)]
    each = flags.join(long.withColumn("_long", F.lit(True)), "session_id", "left").select("session_id", "frame", "y", "ok", "_long", F.explode(F.array_compact(F.array(*sides))).alias("_e"))
    each = each.select("session_id", "_e.*", "frame", "y", "ok", "_long", F.when(F.col("_long"), F.floor(-F.col("_e.score") / mt.STEP)).otherwise(F.lit(0).cast("bigint")).alias("_b"))
    keys = ["session_id", "p", "second"]
    counted = {f"h{i}": _bit("y", i) for i in range(m)} | {f"n{j}": _bit("ok", j) for j in range(n)}

    per = each.where("_long").groupBy(*keys, "_b").agg(*[F.sum(c).alias(x) for x, c in counted.items()])
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", *[F.sum(x).over(ahead).alias(f"_a{x}") for x in counted])

    own = Window.partitionBy(*keys, "_b")
    upto, ties = own.orderBy(F.desc("score"), "frame").rowsBetween(Window.unboundedPreceding, 0), own.orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    r = each.drop("_long").select("*", *[F.sum(c).over(upto).alias(x) for x, c in counted.items()])
    r = r.select("*", *[F.sum(c).over(ties).alias(f"t{x}") for x, c in counted.items()])
    r = r.join(per, [*keys, "_b"], "left")
    before = lambda x: F.coalesce(f"_a{x}", F.lit(0))
    sums = [F.sum(_bit("ok", j)).alias(f"_n{j}") for j in range(n)]
    for i in range(m):
        j, hit = i % n, _bit("y", i) == 1
        hits, places, tp, tn = (F.col(x) + before(y) for x, y in ((f"h{i}", f"h{i}"), (f"n{j}", f"n{j}"), (f"th{i}", f"h{i}"), (f"tn{j}", f"n{j}")))
        precision = F.sum(F.when(hit, hits / places)).alias(f"_s{i}")
        # twice the positives above negatives is what negatives have above or beside them, less the same of positives, plus all
        twice = F.sum(F.when(hit, tp - tn).when(_bit("ok", j) == 1, tp)).alias(f"_u{i}")
        sums += [F.sum(_bit("y", i)).alias(f"_p{i}"), precision, twice]
    g = r.groupBy(*keys).agg(*sums)
    rows = []
    for i in range(m):
        pos = F.col(f"_p{i}")
        all_ = pos * (F.col(f"_n{i % n}") - pos)
        rows.append({"pos": pos, "all": all_, "auroc": F.try_divide((F.col(f"_u{i}") + all_) / 2.0, all_), "ap": F.try_divide(f"_s{i}", pos)})
    out = mt.unpivoted(g, keys, rows).where(F.col("all") > 0)
    name = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("p"))
    signal = F.when(F.col("second"), name([b for _, b in found])).otherwise(name([a for a, _ in found]))
    return lb.named_flags(out, what.kinds, what.horizons_ms).select(name([f"{a}/{b}" for a, b in found]).alias("pair"), "session_id", signal.alias("signal_name"), "kind", "horizon_ms", "auroc", "ap")


def report(points: DataFrame, events: DataFrame, replicates: int, whole: int = WHOLE, **settings) -> DataFrame:
    """``summary`` of every pair of signals that some session has both of, each on its common frames.

    ``points``: session_id, signal_name, frame, value, repeats allowed. Sessions are as long as their last point.
    """
    series = spill(points.groupBy("session_id", "signal_name").agg(F.max("frame").alias("last"), F.count(F.lit(1)).alias("n")), "series")
    found = pairs(series)
    signals = sorted({x for p in found for x in p})
    what = Compare(signals or ["none"], replicates=replicates, **settings)
    if len(what.kinds) * len(what.horizons_ms) > 62:
        raise ValueError("more than 62 labels of a frame")
    long = spill(series.groupBy("session_id").agg(F.max("n").alias("n")).where(F.col("n") > whole).select("session_id"), "long")
    ends = series.groupBy("session_id").agg(((F.max("last") + 1) * tl.FRAME_MS).alias("duration_ms"))
    flags = spill(flagged(points, events, ends, signals or ["none"], what), "flagged")
    per = spill(ranked_pairs(flags, found or [("none", "none")], signals or ["none"], long, what), "compared")
    for t in (series, long, flags):
        drop(t)
    keys = ["pair", *GROUPS[1:]]
    units = per.select("session_id", *keys, F.col("auroc").alias("vw"), F.lit(1.0).alias("w"), "ap")
    most = units.select("session_id").distinct().count()
    ci = rs.interval(rs.bootstrap_alike(units, "session_id", ["vw", "w"], rs.weighted_mean(), what.replicates, what.seed, keys, most), keys)
    means = units.groupBy(*keys).agg(F.avg("vw").alias("auroc"), F.avg("ap").alias("ap"), F.count(F.lit(1)).alias("n_sessions"))
    interval = F.when(F.col("n_sessions") > 1, F.struct("lo", "hi"))
    return means.join(ci, keys, "left").select(*GROUPS[1:], "auroc", "ap", "n_sessions", interval.alias("auroc_ci"), "pair")
