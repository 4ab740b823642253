"""Mixtures of sources with target shares, by temperature mixing.

The weights are an exponential tilt of the sources' own token shares, ``w(x) ~ p * (q / p)^x``: x = 0 is the data as it
is, x = 1 the targets q. With q = p^2 it is the plain temperature family ``p^(1 + x)``. The exponent is found by
bisection. The weights become budgets of tokens, and each budget is spent on a random permutation of the source: whole
passes first, then whole blocks of the permutation, then single documents of one block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.columns import tidy
from turnloom.runtime import spill

#: Most sources that the driver plans for: one row each. More is an error, not a cut.
MAX_SOURCES = 10_000


def tilt(p: dict[str, float], q: dict[str, float], x: float) -> dict[str, float]:
    logs = {s: math.log(p[s]) + x * (math.log(q[s]) - math.log(p[s])) for s in p if p[s] > 0 and q[s] > 0}
    top = max(logs.values(), default=0.0)
    raw = {s: math.exp(v - top) for s, v in logs.items()}
    total = sum(raw.values()) or 1.0
    return {s: raw.get(s, 0.0) / total for s in p}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def divergence(q: dict[str, float], w: dict[str, float]) -> float:
    return sum(v * math.log(v / w[s]) for s, v in q.items() if v > 0 and w[s] > 0)


def bisect(holds, low: float, high: float, steps: int = 100) -> float:
    """The largest x in [low, high] for which the monotone ``holds`` is true (it is true at ``low``)."""
    if holds(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def temperature_weights(tokens: dict[str, int], target_entropy: float, lowest: float = 0.0, highest: float = 1.0) -> tuple[float, dict[str, float]]:
    """(exponent, weights ~ share^exponent) whose entropy comes closest to the target; entropy falls as the exponent grows."""
    total = sum(tokens.values()) or 1
    p = {s: n / total for s, n in tokens.items() if n > 0}
    if not p:
        return 1.0, {}
    at = lambda a: tilt(p, {s: v * v for s, v in p.items()}, a - 1)
    a = bisect(lambda a: entropy(at(a)) >= target_entropy, lowest, highest)
    return a, at(a)


@dataclass
class Plan:
    """Driver-side plan, one row per source: source, tokens, target_bp, max_repeats, exponent, weight, budget."""

    rows: list[dict]
    total: int


def plan_targets(tokens: dict[str, int], total: int, targets: list[dict], steps: int = 200) -> Plan:
    """Budgets for prescribed shares of ``total``. The exponent of each source is bisected to its repetition limit.

    Raised from 0 (the data's own shares) to 1 (the targets), the weight of a source times ``total`` reaches what its
    repeats allow at one place at most: the logarithm of a weight is concave in the exponent, and the own share needs one
    pass at most. A source whose limit binds below 1 stops there, with all its repeats as its budget; the others go on to
    their targets. Where ``max_repeats`` is 0 the exponent is 0 and so is the budget.
    """
    q = {t["source"]: t["target_bp"] / 10_000 for t in targets}
    whole = sum(max(tokens.get(s, 0), 0) for s in q) or 1
    p = {s: max(tokens.get(s, 0), 0) / whole for s in q}
    reach = sum(v for s, v in q.items() if p[s] > 0)  # sources without a token get no weight; the others keep their share of the total
    rows = []
    for t in targets:
        s, have = t["source"], tokens.get(t["source"], 0)
        limit = have * t["max_repeats"]

        def fits(x: float, s: str = s, limit: int = limit, bp: int = t["target_bp"]) -> bool:
            # the end is compared in whole numbers, so that a target met exactly counts as met
            return bp * total <= limit * 10_000 if x >= 1 else tilt(p, q, x)[s] * reach * total <= limit

        x = bisect(fits, 0.0, 1.0, steps) if have > 0 and q[s] > 0 else 1.0
        weight = tilt(p, q, x)[s] * reach if x < 1 else q[s] * (p[s] > 0)
        rows.append({"source": s, "tokens": have, "target_bp": t["target_bp"], "max_repeats": t["max_repeats"], "exponent": x, "weight": weight, "budget": limit if x < 1 else min(limit, t["target_bp"] * total // 10_000)})
    return Plan(rows, total)


def realised(plan: Plan, used: dict[str, int]) -> dict[str, bool]:
    """Whether each source falls short in the mixture as it was spent: all its repeats are used and its target isn't reached.

    The exact check after it: a source that falls short lacks what its tokens lack in whole numbers, and any other one is
    within its budget. Anything else is an error.
    """
    out = {}
    for r in plan.rows:
        s, n = r["source"], used.get(r["source"], 0)
        if n > r["budget"]:
            raise ValueError(f"{s}: {n} tokens used of a budget of {r['budget']}")
        out[s] = n == r["tokens"] * r["max_repeats"] and n * 10_000 < r["target_bp"] * plan.total
        if out[s] != (r["tokens"] * r["max_repeats"] * 10_000 < r["target_bp"] * plan.total):
            raise ValueError(f"{s}: {n} tokens used, which is not what its repeats allow")
    return out


def spend(docs: DataFrame, plan: DataFrame, blocks: int = 1024, seed: int = 3) -> DataFrame:
    """How often each document is used: (doc_id, source, n_tokens, n_uses), only documents that are used.

    ``docs``: doc_id, source, n_tokens; ``plan``: source, tokens, budget. Every source is permuted by a hash; the
    permutation is cut into blocks; a block's place in the budget comes from the blocks' sums (``blocks`` rows per
    source), a document's from its own block alone, so no task sorts more than a block. The documents in front of the
    first one that the rest of the budget can't pay in full are taken once more.
    """
    h = F.xxhash64("doc_id", F.lit(seed))
    placed = docs.where("n_tokens > 0").join(plan.where("tokens > 0").select("source", "tokens", "budget"), "source")
    placed = placed.withColumn("h", h).withColumn("block", F.floor((F.shiftrightunsigned("h", 1) / F.lit(2.0**63)) * blocks))
    placed = placed.withColumn("passes", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens"))
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    run = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ahead = sums.select("source", "block", "block_tokens", (F.sum("block_tokens").over(run) - F.col("block_tokens")).alias("ahead"))
    where = placed.join(ahead, ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("ahead") + F.col("block_tokens") <= F.col("rest")
    out = F.col("ahead") >= F.col("rest")
    settled = where.where(whole | out).withColumn("more", whole.cast("int"))
    border = where.where(~whole & ~out).withColumn("more", (F.col("ahead") + F.sum("n_tokens").over(inside) <= F.col("rest")).cast("int"))
    uses = settled.unionByName(border).withColumn("n_uses", F.col("passes") + F.col("more"))
    return uses.where("n_uses > 0").select("doc_id", "source", "n_tokens", "n_uses")


def _by_source(docs: DataFrame) -> tuple[dict[str, int], int]:
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["source"]: r["n"] for r in sums if r["source"] is not None}, sum(r["n"] for r in sums)


def mix_to_targets(docs: DataFrame, targets: DataFrame, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(uses, report) of a mixture in which each source has its share of the size of all documents together.

    ``docs``: doc_id, source, n_tokens; ``targets``: source, target_bp, max_repeats. Source names are compared trimmed
    and lower-cased; documents of other or no sources count for the total but aren't used; null sizes count as 0; other
    columns are dropped. Empty input: no uses, and every source with a target above 0 falls short of nothing. A source
    that doesn't fall short is used to within one document of its share; what others lack is not given to it.
    Report: source, tokens, max_repeats, target_share, exponent, weight, budget, used_tokens, share_of_total (used tokens
    over the tokens of all documents), actual_share (over those of the mixture), falls_short.
    """
    spark = docs.sparkSession
    clean = spill(docs.select("doc_id", tidy("source").alias("source"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens")), "sizes")
    tokens, total = _by_source(clean)
    goals = targets.select(tidy("source").alias("source"), "target_bp", "max_repeats").dropna().dropDuplicates(["source"]).limit(MAX_SOURCES + 1).collect()
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    plan = plan_targets(tokens, total, [r.asDict() for r in goals])
    table = spark.createDataFrame([(r["source"], r["tokens"], r["budget"]) for r in plan.rows], "source string, tokens bigint, budget bigint")
    uses = spill(spend(clean, table, seed=seed), "uses")
    sums = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n")).collect()  # sources of the plan only
    used = {r["source"]: r["n"] for r in sums}
    whole = sum(used.values())
    short = realised(plan, used)
    share = lambda n, of: n / of if of else None
    rows = [
        (r["source"], r["tokens"], r["max_repeats"], r["target_bp"] / 10_000, r["exponent"], float(r["weight"]), r["budget"], n := used.get(r["source"], 0), share(n, total), share(n, whole), short[r["source"]])
        for r in plan.rows
    ]
    schema = "source string, tokens bigint, max_repeats int, target_share double, exponent double, weight double, budget bigint, used_tokens bigint, share_of_total double, actual_share double, falls_short boolean"
    return uses, spark.createDataFrame(rows, schema)


def mix_by_temperature(docs: DataFrame, target_entropy_share: float = 0.9, max_repeats: int = 4, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(uses, report) without targets: weights ~ share^exponent with ``target_entropy_share`` of the largest entropy.

    The exponent is raised toward 1 where a small source would be repeated more than ``max_repeats`` times. Report:
    source, tokens, exponent, weight, used_tokens, actual_share.
    """
    spark = docs.sparkSession
    clean = spill(docs.select("doc_id", tidy("source").alias("source"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens")).where("source <> ''"), "sizes")
    tokens, total = _by_source(clean)
    tokens = {s: n for s, n in tokens.items() if n > 0}
    a, w = temperature_weights(tokens, target_entropy_share * math.log(max(len(tokens), 1)))
    if any(w[s] * total > max_repeats * tokens[s] for s in w):
        p = {s: n / total for s, n in tokens.items()}
        at = lambda z: tilt(p, {s: v * v for s, v in p.items()}, z - 1)
        a = 1 - bisect(lambda y: all(at(1 - y)[s] * total <= max_repeats * tokens[s] for s in p), 0.0, 1 - a)
        w = at(a)
    rows = [(s, tokens[s], a, w[s], int(min(w[s] * total, max_repeats * tokens[s]))) for s in sorted(w)]
    table = spark.createDataFrame(rows, "source string, tokens bigint, exponent double, weight double, budget bigint")
    uses = spill(spend(clean, table, seed=seed), "uses")
    used = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used"))
    whole = used.agg(F.sum("used")).first()[0] or 0
    report = table.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used", F.lit(0)))
    return uses, report.select("source", "tokens", "exponent", "weight", "used_tokens", F.try_divide(F.col("used_tokens").cast("double"), F.lit(float(whole))).alias("actual_share"))
