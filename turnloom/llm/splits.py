"""Splits that keep related records together: random-mate contraction of the graph of shared ids.

Every round a hash tosses a coin for each vertex. A vertex with tails that has a neighbour with heads joins the
smallest such neighbour; edges are renamed, loops and repeats vanish. An expected constant share of the vertices with
edges disappears each round, so the rounds are logarithmic in the vertices, whatever the shape of the graph. The steps
are kept and unwound from the last to the first to label every vertex. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.runtime import drop, spill


def _heads(c: str, turn: int):
    return F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 1


def components(edges: DataFrame, seed: int = 11, rounds: int = 200) -> DataFrame:
    """Label of each vertex of ``edges`` (a, b): (vertex, label), equal labels for connected vertices.

    Loops make a vertex without joining anything; repeats don't matter; edges with a null end are left out. A label is
    the name of some vertex of the component. No edges give no rows.
    """
    edges = edges.select("a", "b").dropna()
    vertices = edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    vertices = spill(vertices, "vertices")
    live = spill(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    for turn in range(rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joins = both.where(~_heads("a", seed * 1000 + turn) & _heads("b", seed * 1000 + turn)).groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("into"))
        joins = spill(joins, "joins")
        steps.append(joins)
        renamed = live
        for end in ("a", "b"):
            m = joins.select(F.col("vertex").alias(end), F.col("into").alias("into"))
            renamed = renamed.join(m, end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        renamed = renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        after = spill(renamed, "edges")
        drop(live)
        live = after
    else:
        raise RuntimeError("edges are left after all rounds")
    labels: DataFrame | None = None
    for joins in reversed(steps):  # a vertex that took part later already has its label
        if labels is None:
            labels = joins.select("vertex", F.col("into").alias("label"))
        else:
            later = labels.select(F.col("vertex").alias("into"), "label")
            now = joins.join(later, "into", "left").select("vertex", F.coalesce("label", "into").alias("label"))
            before, labels = labels, spill(labels.unionByName(now), "labels")
            drop(before)
    if labels is None:
        return vertices.select("vertex", F.col("vertex").alias("label"))
    return vertices.join(labels, "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("label"))


def _position(weights: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Adds ``before``: the weight of all components ahead in the order of a hash. Sums by bucket, then within a bucket."""
    placed = weights.withColumn("h", F.xxhash64("label", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = placed.groupBy("bucket").agg(F.sum("w").alias("bw"))  # at most ``buckets`` rows
    ahead = sums.select("bucket", (F.sum("bw").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bw")).alias("ahead"))
    inner = Window.partitionBy("bucket").orderBy("h", "label").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(ahead, "bucket").withColumn("before", F.col("ahead") + F.sum("w").over(inner) - F.col("w")).drop("h", "bucket", "ahead")


def grouped_splits(
    records: DataFrame, keys: list[str], shares: dict[str, float], large: float = 0.01, buckets: int = 1024, seed: int = 11
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records with ``split``, vertex labels, report): records that share a value of any key land in the same split.

    ``keys`` are the columns of ids, already normalised; null joins nothing, and a record without any id is a component
    of its own (by its whole row). ``shares`` maps split names to positive numbers. Components of at least ``large`` of
    the weight (at most 1 / large of them) go, largest first, to the split with the largest remaining quota; the others
    fill what remains in the order of a hash, by cumulative weight. All columns and repeated rows of ``records`` are
    kept; a clashing column ``split`` is replaced. Labels: vertex ('column:value'), label. Report: split, share,
    wanted, n_records, n_components.
    """
    names = list(shares)
    total_share = float(sum(shares.values()))
    marks = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys]
    own = F.concat(F.lit("row:"), F.sha2(F.to_json(F.struct(*[F.col(c) for c in records.columns if c != "split"])), 256))
    hub = F.coalesce(*marks, own)
    kept = records.drop("split").withColumn("_hub", hub)
    edges = records.select(hub.alias("a"), F.explode(F.array_compact(F.array(*marks, hub))).alias("b")).distinct()
    labels = spill(components(edges, seed), "components")
    counts = spill(kept.groupBy("_hub").agg(F.count(F.lit(1)).alias("n")), "counts")
    weights = spill(counts.join(labels, F.col("_hub") == F.col("vertex")).groupBy("label").agg(F.sum("n").alias("w")), "weights")
    total = weights.agg(F.sum("w")).first()[0] or 0
    quota = {n: total * shares[n] / total_share for n in names}
    room = dict(quota)
    big = weights.where(F.col("w") >= max(1.0, large * total)).orderBy(F.desc("w"), "label").limit(int(1 / large) + 1).collect()  # at most 1 / large rows
    fixed: dict[str, str] = {}
    for row in big:
        best = max(names, key=lambda n: room[n])
        fixed[row["label"]] = best
        room[best] -= row["w"]
    spark = records.sparkSession
    chosen = spark.createDataFrame(list(fixed.items()), "label string, fixed string")
    small = weights.join(chosen, "label", "left_anti")
    rest = total - sum(r["w"] for r in big)
    free = {n: max(0.0, room[n]) for n in names}
    scale = rest / (sum(free.values()) or 1.0)
    middle, end = F.col("before") + F.col("w") / 2, 0.0
    pick = F.lit(names[-1])
    for n, upto in reversed([(n, end := end + free[n] * scale) for n in names[:-1]]):
        pick = F.when(middle < upto, n).otherwise(pick)
    split = spill(_position(small, buckets, seed).select("label", pick.alias("split"), "w").unionByName(weights.join(chosen, "label").select("label", F.col("fixed").alias("split"), "w")), "split")
    out = kept.join(labels.join(split, "label").select(F.col("vertex").alias("_hub"), "split"), "_hub").drop("_hub")
    wanted = spark.createDataFrame([(n, shares[n] / total_share, float(quota[n])) for n in names], "split string, share double, wanted double")
    got = split.groupBy("split").agg(F.sum("w").alias("n_records"), F.count(F.lit(1)).alias("n_components"))
    report = wanted.join(got, "split", "left").select("split", "share", "wanted", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_records", "n_components")])
    return out, labels, report
