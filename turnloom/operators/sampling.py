"""Splits, top-k per group, balanced selection and assignment."""

from __future__ import annotations

import hashlib
import heapq
import random
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.columns import hash_share

PLACES = [("train", 0.70), ("validation", 0.85), ("test", 1.0)]


def hash_split(seed: int, key: str, challenge: Column | None = None) -> Column:
    """train / validation / test by a hash of seed and key (70 / 15 / 15); challenge rows are a split of their own."""
    x = hash_share(F.lit(seed), key)
    out = F.when(x < PLACES[0][1], PLACES[0][0]).when(x < PLACES[1][1], PLACES[1][0]).otherwise(PLACES[2][0])
    return out if challenge is None else F.when(challenge, "challenge").otherwise(out)


def top_groups(df: DataFrame, group: str, member: str, k: int, seed: int) -> DataFrame:
    """All rows of the k members of each group that a hash of (seed, group, member) ranks first."""
    members = df.select(group, member).distinct()
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(group), F.col(member)), 256)
    w = Window.partitionBy(group).orderBy(digest, member)
    return df.join(members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r"), [group, member], "left_semi")


def per_split(df: DataFrame, schema: str, work, group: str | None = None) -> DataFrame:
    """Runs a sequential choice on one task (or one per group): for candidate sets that were aggregated down before."""
    return (df.groupBy(group) if group else df.groupBy()).applyInPandas(work, schema)


def balanced_pilot(candidates: DataFrame, size: int, min_lineages: int, seed: int, partial: bool = False) -> DataFrame:
    """Greedy pilot of one item per episode: (item, episode, lineage, source, stratum, place).

    Each pick is the least by (picks of its source and stratum, of its source, of its stratum, of its lineage, hash,
    episode, elapsed) among the episodes that are left; while fewer than ``min_lineages`` lineages are in, an unseen one
    goes first if there is any. Too few episodes or lineages are an error, unless ``partial`` takes what there is.
    ``candidates``: item, episode, lineage, source, stratum (strings), elapsed (double); rows with a null are left out.

    Sequential by nature, so the candidates are cut beforehand to what can be picked at all: within a cell of source and
    stratum only lineages among the ``size + 1`` with the least hash (one of them is always still unseen), and of each the
    ``size`` first episodes. So one task gets at most cells * (size + 1) * size rows, however large the input.
    """
    if size < 1 or not 1 <= min_lineages <= size:
        raise ValueError("the size and the least number of lineages don't fit")
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.lit("pilot"), "episode", F.col("elapsed").cast("string")), 256)
    c = candidates.select("item", "episode", "lineage", "source", "stratum", "elapsed").dropna().withColumn("h", digest)
    cell, line = ["source", "stratum"], ["source", "stratum", "lineage"]
    one = c.groupBy(*line, "episode").agg(F.min(F.struct("h", "elapsed", "item")).alias("r")).select(*line, "episode", "r.*")
    best = one.groupBy(*line).agg(F.min("h").alias("_least"))
    lines = best.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy("_least", "lineage"))).where(F.col("_r") <= size + 1)
    cut = one.join(lines.select(*line), line, "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(*line).orderBy("h", "episode"))).where(F.col("_r") <= size)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "episode", "elapsed"]).reset_index(drop=True)
        n_cell, code = {}, {}
        for name, columns in (("cell", cell), ("source", ["source"]), ("stratum", ["stratum"]), ("lineage", ["lineage"]), ("episode", ["episode"])):
            code[name] = pdf.groupby(columns, sort=False).ngroup().to_numpy()
            n_cell[name] = np.zeros(code[name].max() + 1 if len(pdf) else 0, np.int64)
        free, out = np.ones(len(pdf), bool), []
        while len(out) < size and free.any():
            pool = free
            if (n_cell["lineage"] > 0).sum() < min_lineages:
                unseen = free & (n_cell["lineage"][code["lineage"]] == 0)
                pool = unseen if unseen.any() else free
            at = np.flatnonzero(pool)
            rank = np.zeros(len(at), np.int64)
            for name in ("cell", "source", "stratum", "lineage"):
                rank = rank * (size + 1) + n_cell[name][code[name][at]]
            i = int(at[rank.argmin()])  # the first of equal ranks: rows are in the order of the hash
            for name in n_cell:
                n_cell[name][code[name][i]] += 1
            free &= code["episode"] != code["episode"][i]
            out.append(i)
        if not partial and len(out) < size:
            raise ValueError(f"{size} episodes are needed, {len(out)} are there")
        if not partial and (n_cell["lineage"] > 0).sum() < min_lineages:
            raise ValueError(f"{min_lineages} lineages are needed, {int((n_cell['lineage'] > 0).sum())} are there")
        return pdf.loc[out, ["item", "episode", "lineage", "source", "stratum"]].assign(place=np.arange(len(out), dtype=np.int32))

    return per_split(cut.drop("_r"), "item string, episode string, lineage string, source string, stratum string, place int", pick)


def assign(items: DataFrame, annotators: list[str], per_item: int, seed: int) -> DataFrame:
    """``per_item`` annotators for each item, the least loaded first and none twice on one lineage: (item, annotator).

    A pool too small to keep a lineage's items apart is an error. For the items of a pilot: one task gets all of them.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        key = lambda *x: hashlib.sha256(":".join(map(str, (seed, *x))).encode()).hexdigest()
        rank = {a: i for i, a in enumerate(sorted(annotators, key=lambda a: key("annotator", a)))}
        load, lines = dict.fromkeys(annotators, 0), defaultdict(list)
        for r in sorted(pdf.to_dict("records"), key=lambda r: key("item", r["item"])):
            lines[r["lineage"]].append(r["item"])
        out = []
        for lineage, mine in lines.items():
            if len(mine) * per_item > len(annotators):
                raise ValueError(f"{len(annotators)} annotators can't keep the {len(mine)} items of {lineage} apart")
            free = set(annotators)
            for item in mine:
                for a in sorted(free, key=lambda a: (load[a], rank[a]))[:per_item]:
                    load[a] += 1
                    free.remove(a)
                    out.append({"item": item, "annotator": a})
        return pd.DataFrame(out, columns=["item", "annotator"])

    return per_split(items.select("item", "lineage"), "item string, annotator string", work)


def with_repeats(assigned: DataFrame, share: float, seed: int) -> DataFrame:
    """Adds repeats: floor(share * n + 0.5), at least one, of each annotator's items, the first in the order of a hash."""
    w = Window.partitionBy("annotator")
    digest = F.sha2(F.concat_ws(":", F.lit(seed), "annotator", "item"), 256)
    ranked = assigned.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(digest)))
    again = ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share + 0.5)))
    return ranked.select("item", "annotator", F.lit(False).alias("is_repeat")).unionByName(again.select("item", "annotator", F.lit(True).alias("is_repeat")))


def spaced_queue(assigned: DataFrame, seed: int) -> DataFrame:
    """Each annotator's order without two neighbours of one episode where that is possible: the largest rest goes first."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(f"{seed}:{pdf['annotator'].iloc[0]}")
        rest = defaultdict(list)
        for r in pdf.sort_values("item").to_dict("records"):
            rest[r["episode"]].append(r)
        for rows in rest.values():
            rng.shuffle(rows)
        # the largest rest first (of equal ones the greater name), never the episode just taken while another is left
        names = sorted(rest, reverse=True)
        heap = [(-len(rest[e]), i) for i, e in enumerate(names)]
        heapq.heapify(heap)
        out, waiting = [], None
        while heap or waiting:
            if not heap:
                heap, waiting = [waiting], None
            n, i = heapq.heappop(heap)
            if waiting:
                heapq.heappush(heap, waiting)
            out.append(rest[names[i]].pop() | {"place": len(out)})
            waiting = (n + 1, i) if n < -1 else None
        return pd.DataFrame(out)[["annotator", "item", "episode", "place"]]

    return per_split(assigned.select("annotator", "item", "episode"), "annotator string, item string, episode string, place int", work, "annotator")


def shuffled_within(df: DataFrame, groups: list[str], id_col: str, value: str, seed: int) -> DataFrame:
    """Permutes ``value`` within each group: the row at place k gets the value of the k-th row in the order of a hash."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256)
    by_id = df.withColumn("_k", F.row_number().over(Window.partitionBy(*groups).orderBy(id_col)))
    by_hash = df.withColumn("_k", F.row_number().over(Window.partitionBy(*groups).orderBy(digest, id_col))).select(*groups, "_k", F.col(value).alias(f"{value}_shuffled"))
    return by_id.join(by_hash, [*groups, "_k"]).drop("_k")
