"""Agreement between raters, from counts per item: no list of an item's ratings is ever built.

``ratings`` has item, annotator, action (null: abstained) and whatever the groups need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ["ack", "repair", "respond", "wait"]


def item_counts(ratings: DataFrame, groups: list[str], classes: list[str] = ACTIONS) -> DataFrame:
    """Per group and item: c_<class> and m, the number of ratings that count."""
    g = ratings.where(F.col("action").isin(classes)).groupBy(*groups, "item").agg(*[F.count(F.when(F.col("action") == c, 1)).alias(f"c_{c}") for c in classes])
    return g.withColumn("m", sum((F.col(f"c_{c}") for c in classes), F.lit(0)))


def alpha_sums(items: DataFrame, groups: list[str], classes: list[str] = ACTIONS) -> DataFrame:
    """Additive parts of alpha per group: total, disagreed, and t_<class>; items with fewer than two ratings don't count."""
    m = F.col("m")
    squares = sum((F.col(f"c_{c}") * F.col(f"c_{c}") for c in classes), F.lit(0))
    ok = items.where("m >= 2")
    return ok.groupBy(*groups).agg(F.count(F.lit(1)).alias("items"), F.sum("m").alias("total"), F.sum((m * m - squares) / (m - 1)).alias("disagreed"), *[F.sum(f"c_{c}").alias(f"t_{c}") for c in classes])


def alpha_of(classes: list[str] = ACTIONS) -> Column:
    """Nominal alpha from ``alpha_sums``; null below two ratings or where only one class occurs."""
    total = F.col("total").cast("double")
    expected = total * total - sum((F.col(f"t_{c}") * F.col(f"t_{c}") for c in classes), F.lit(0))
    return F.when(total >= 2, 1 - F.try_divide(F.col("disagreed") * (total - 1), expected))


def krippendorff(ratings: DataFrame, groups: list[str], classes: list[str] = ACTIONS) -> DataFrame:
    sums = alpha_sums(item_counts(ratings, groups, classes), groups, classes)
    return sums.select(*groups, "items", F.col("total").alias("ratings"), alpha_of(classes).alias("alpha"))


def confusion(ratings: DataFrame, groups: list[str], classes: list[str] = ACTIONS) -> DataFrame:
    """Ordered pairs of two ratings of an item, by their classes, zeros included: (a, b, pairs)."""
    items = item_counts(ratings, groups, classes)
    pairs = [(a, b, F.sum(F.col(f"c_{a}") * (F.col(f"c_{b}") - (1 if a == b else 0))).alias(f"p_{a}_{b}")) for a in classes for b in classes]
    one = items.groupBy(*groups).agg(*[p for *_, p in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"p_{a}_{b}"), F.lit(0)).alias("pairs")) for a, b, _ in pairs]))
    return one.select(*groups, rows.alias("r")).select(*groups, "r.*")


def positive_agreement(ratings: DataFrame, groups: list[str], classes: list[str] = ACTIONS) -> DataFrame:
    """2 * both / (2 * both + one of the two) per class; null where the class never occurs in a pair."""
    c = confusion(ratings, groups, classes)
    same = F.sum(F.when(F.col("a") == F.col("b"), F.col("pairs")).otherwise(0))
    other = F.sum(F.when(F.col("a") != F.col("b"), F.col("pairs")).otherwise(0))
    g = c.groupBy(*groups, F.col("a").alias("action")).agg(same.alias("_d"), other.alias("_o"))
    return g.select(*groups, "action", F.try_divide(2 * F.col("_d"), 2 * F.col("_d") + 2 * F.col("_o")).alias("agreement"))


def onset_disagreement(onsets: DataFrame, groups: list[str]) -> DataFrame:
    """Mean absolute difference of onset windows over the pairs of an item, and how often waiting meets a window.

    ``onsets``: item, earliest, latest, waits (boolean) and the groups. Sums over pairs come from sorted places: the k-th
    smallest of n values enters (2k - n - 1) times.
    """
    rows = onsets.where("waits is not null")
    keys = [*groups, "item"]
    windows = rows.where("not waits").dropna(subset=["earliest", "latest"])
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    spread = lambda c: (2 * F.row_number().over(Window.partitionBy(*keys).orderBy(c)) - n - 1) * F.col(c)
    per = windows.select(*keys, spread("earliest").alias("_e"), spread("latest").alias("_l")).groupBy(*keys).agg(F.sum("_e").alias("_e"), F.sum("_l").alias("_l"), F.count(F.lit(1)).alias("_n"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("waits"), 1)).alias("_w"))
    j = totals.join(per, keys, "left")
    half = lambda x: x * (x - 1) / 2
    g = j.groupBy(*groups).agg(
        F.sum(half(F.col("_all"))).cast("bigint").alias("compared_pairs"),
        F.sum(half(F.coalesce("_n", F.lit(0)))).cast("bigint").alias("finite_pairs"),
        F.sum("_e").alias("_e"),
        F.sum("_l").alias("_l"),
        F.sum(F.col("_w") * (F.col("_all") - F.col("_w"))).alias("mismatches"),
    )
    return g.select(*groups, "compared_pairs", "finite_pairs", F.try_divide("_e", "finite_pairs").alias("earliest_mad"), F.try_divide("_l", "finite_pairs").alias("latest_mad"), "mismatches", F.try_divide("mismatches", "compared_pairs").alias("mismatch_rate"))


def unratable_rate(ratings: DataFrame, groups: list[str], raw: str = "raw_action") -> DataFrame:
    return ratings.groupBy(*groups).agg(F.avg((F.col(raw) == "unratable").cast("double")).alias("unratable_rate"))


def repeat_consistency(rows: DataFrame) -> DataFrame:
    """Repeats against the original answer of the same annotator to the same item. ``rows``: annotator, item, is_repeat, raw_action."""
    original = rows.where("not is_repeat").select("annotator", "item", F.col("raw_action").alias("_first"))
    j = rows.where("is_repeat").join(original, ["annotator", "item"], "left")
    g = j.agg(F.count(F.lit(1)).alias("repeats"), F.count("_first").alias("paired"), F.count(F.when(F.col("_first") == F.col("raw_action"), 1)).alias("agreed"))
    return g.withColumn("unpaired", F.col("repeats") - F.col("paired")).withColumn("consistency", F.try_divide("agreed", "paired"))


def report(ratings: DataFrame, corpora: str = "source", stratum: str = "stratum", strata: list[str] | None = None) -> DataFrame:
    """Alpha and counts over all, by corpus, and by stratum in one pass; strata without items are there with nulls."""
    base = ratings.where(F.col("action").isNotNull())
    items = item_counts(base, [corpora, stratum])
    m = F.col("m")
    squares = sum((F.col(f"c_{c}") * F.col(f"c_{c}") for c in ACTIONS), F.lit(0))
    ok = items.where("m >= 2").withColumn("_d", (m * m - squares) / (m - 1))
    sums = ", ".join(f"sum(c_{c}) as t_{c}" for c in ACTIONS)
    cube = ok.sparkSession.sql(f"""select {corpora}, {stratum}, grouping_id() as level, count(*) as items, sum(m) as total, sum(_d) as disagreed, {sums}
        from {{items}} group by grouping sets ((), ({corpora}), ({stratum}))""", items=ok)
    level = F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "corpus").otherwise("stratum")
    out = cube.select(level.alias("level"), F.coalesce(F.col(corpora), F.col(stratum), F.lit("all")).alias("name"), "items", alpha_of().alias("alpha"))
    if strata:
        every = ok.sparkSession.createDataFrame([("stratum", s) for s in strata], "level string, name string")
        lacking = every.join(out, ["level", "name"], "left_anti").select("level", "name", F.lit(0).cast("bigint").alias("items"), F.lit(None).cast("double").alias("alpha"))
        out = out.unionByName(lacking)
    return out


def majority(ratings: DataFrame, needed: int = 2) -> DataFrame:
    """Outcome per item: 'excluded' if ``needed`` raters found it unratable, else the action that ``needed`` gave, else null.

    ``ratings``: item, raw_action. Of several such actions the most frequent, then the greater name.
    """
    per = ratings.groupBy("item", "raw_action").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("item").agg(F.sum("n").alias("n_ratings"), F.coalesce(F.max(F.when(F.col("raw_action") == "unratable", F.col("n"))), F.lit(0)).alias("_u"), F.max(F.when((F.col("raw_action") != "unratable") & (F.col("n") >= needed), F.struct("n", "raw_action"))).alias("_b"))
    outcome = F.when(F.col("_u") >= needed, "excluded").when(F.col("_b").isNotNull(), "resolved").otherwise("unresolved")
    return g.select("item", "n_ratings", outcome.alias("outcome"), F.when(F.col("_u") < needed, F.col("_b.raw_action")).alias("action"))


def distribution(ratings: DataFrame, classes: list[str] = ACTIONS) -> DataFrame:
    """Per item the share of each class (0 included) among its ratable answers, and the mean confidence of all answers."""
    g = ratings.groupBy("item").agg(*[F.count(F.when(F.col("action") == c, 1)).alias(c) for c in classes], F.avg("confidence").alias("confidence"))
    n = sum((F.col(c) for c in classes), F.lit(0))
    return g.select("item", *[F.try_divide(F.col(c), n).alias(f"p_{c}") for c in classes], "confidence")
