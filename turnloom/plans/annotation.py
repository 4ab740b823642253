"""Queries on checkpoints, assignments and answers: agreement, bootstraps, samples, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.columns import hash_share, tidy
from turnloom.operators import agreement as ag
from turnloom.operators import resample as rs
from turnloom.operators import sampling as sp
from turnloom.operators import validation as va
from turnloom.plans import views as v
from turnloom.plans.views import sql
from turnloom.runtime import table

Q: dict = {}
SQL: dict[str, str] = {}
SEED = 20260903


def query(text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


_COUNTS = ", o as (select * from ratings where not is_repeat and action in ('ack', 'repair', 'respond', 'wait'))"


def _alpha(groups: str = "") -> str:
    """Alpha per group in SQL, from table o."""
    g = f"{groups}, " if groups else ""
    using = f"join e using ({groups})" if groups else "cross join e"
    return f""", n as (select {g}item, action, count(*) as n from o group by all), i as (select {g}item, sum(n) as m, sum(n * n) as sq from n group by all having sum(n) >= 2),
t as (select {g}action, sum(n) as n from n join i using ({g}item) group by all), e as (select {g}sum(n * n) as sq from t group by all),
d as (select {g}count(*) as items, sum(m) as total, sum((m * m - sq) / (m - 1.0)) as d from i group by all)
select {g}items, cast(total as bigint) as ratings, round(1 - d * (total - 1) / nullif(total * total - e.sq, 0), 6) as alpha from d {using}"""


def _originals(spark: SparkSession, d: str) -> DataFrame:
    return v.ratings(spark, d).where("not is_repeat")


@query(sql("ratings", _COUNTS + _alpha()))
def agg_15_alpha(spark, d):
    return ag.krippendorff(_originals(spark, d), []).withColumn("alpha", F.round("alpha", 6))


@query(sql("ratings", _COUNTS + _alpha("source")))
def agg_22_alpha_by_corpus(spark, d):
    return ag.krippendorff(_originals(spark, d), ["source"]).withColumn("alpha", F.round("alpha", 6))


@query(sql("ratings", """, o as (select * from ratings where not is_repeat and action is not null), i as (
  select source, stratum, item, count(*) as m, count(*) filter (action = 'ack') as c1, count(*) filter (action = 'repair') as c2, count(*) filter (action = 'respond') as c3, count(*) filter (action = 'wait') as c4 from o group by all having count(*) >= 2),
g as (select source, stratum, grouping(source, stratum) as l, count(*) as items, sum(m) as total, sum((m * m - c1 * c1 - c2 * c2 - c3 * c3 - c4 * c4) / (m - 1.0)) as d, sum(c1) as t1, sum(c2) as t2, sum(c3) as t3, sum(c4) as t4 from i group by grouping sets ((), (source), (stratum)))
select case l when 3 then 'all' when 1 then 'corpus' else 'stratum' end as level, coalesce(source, stratum, 'all') as name, items, round(1 - d * (total - 1) / nullif(total * total - t1 * t1 - t2 * t2 - t3 * t3 - t4 * t4, 0), 6) as alpha from g"""))
def agg_22_report(spark, d):
    """Alpha over all, by corpus and by stratum from one pass with grouping sets."""
    return ag.report(_originals(spark, d), strata=v.STRATA).withColumn("alpha", F.round("alpha", 6))


_GRID = "(select unnest(['ack', 'repair', 'respond', 'wait']) as {0})"


@query(sql("ratings", _COUNTS + f""", p as (select x.action as a, y.action as b, count(*) as pairs from o x join o y on x.item = y.item and x.annotator <> y.annotator group by all)
select a, b, coalesce(pairs, 0) as pairs from {_GRID.format("a")} cross join {_GRID.format("b")} left join p using (a, b)"""))
def agg_16_confusion(spark, d):
    return ag.confusion(_originals(spark, d), [])


@query(sql("ratings", _COUNTS + """, p as (select x.action as a, y.action as b, count(*) as n from o x join o y on x.item = y.item and x.annotator <> y.annotator group by all),
s as (select a as action, sum(n) filter (a = b) as d, coalesce(sum(n) filter (a <> b), 0) as x from p group by all) select action, round(2 * d / (2 * d + 2 * x), 6) as agreement from s"""))
def agg_17_positive_agreement(spark, d):
    return ag.positive_agreement(_originals(spark, d), []).withColumn("agreement", F.round("agreement", 6))


@query(sql("ratings", """, o as (select item, annotator, earliest, latest, waits from ratings where not is_repeat and waits is not null),
p as (select x.waits as xw, y.waits as yw, abs(x.earliest - y.earliest) as e, abs(x.latest - y.latest) as l from o x join o y on x.item = y.item and x.annotator < y.annotator)
select count(*) as compared_pairs, count(*) filter (not xw and not yw) as finite_pairs, round(avg(e) filter (not xw and not yw), 6) as earliest_mad, round(avg(l) filter (not xw and not yw), 6) as latest_mad,
  count(*) filter (xw <> yw) as mismatches, round(avg((xw <> yw)::int), 6) as mismatch_rate from p"""))
def agg_18_onset_disagreement(spark, d):
    out = ag.onset_disagreement(_originals(spark, d), [])
    return out.select("compared_pairs", "finite_pairs", F.round("earliest_mad", 6).alias("earliest_mad"), F.round("latest_mad", 6).alias("latest_mad"), "mismatches", F.round("mismatch_rate", 6).alias("mismatch_rate"))


@query(sql("ratings", "select source, round(avg((raw_action = 'unratable')::int), 6) as unratable_rate from ratings where not is_repeat group by all"))
def agg_19_unratable_rate(spark, d):
    return ag.unratable_rate(_originals(spark, d), ["source"]).withColumn("unratable_rate", F.round("unratable_rate", 6))


@query(sql("ratings", """, j as (select r.raw_action as again, o.raw_action as first from (select * from ratings where is_repeat) r left join (select * from ratings where not is_repeat) o using (annotator, item))
select count(*) as repeats, count(first) as paired, count(*) filter (first = again) as agreed, count(*) - count(first) as unpaired, round(count(*) filter (first = again) / nullif(count(first), 0), 6) as consistency from j"""))
def agg_20_repeat_consistency(spark, d):
    """Self join of repeats and originals (JOIN-12, AGG-20)."""
    return ag.repeat_consistency(v.ratings(spark, d)).withColumn("consistency", F.round("consistency", 6))


_DRAW = "cast(('0x' || substr(sha256('{seed}:' || b || ':' || i), 1, 15)) as bigint) % n"


def _boot(units: str, key: str, statistic: str, n: int = 200) -> str:
    """SQL of a hash bootstrap over table ``units``: sums per replicate, then the statistic."""
    return f""", pl as (select *, row_number() over (order by {key}) - 1 as u, count(*) over () as n from {units}),
dr as (select b, {_DRAW.format(seed=SEED)} as u from (select b, unnest(range(n)) as i, n from (select distinct n from pl), (select unnest(range({n})) as b))),
tm as (select b, u, count(*) as times from dr group by all),
va as (select b, {statistic} as value from tm join pl using (u) group by b)"""


_CI = " select round(quantile_cont(value, 0.025), 6) as lo, round(quantile_cont(value, 0.975), 6) as hi, count(value) as n_valid, count(*) - count(value) as n_null from va"


def _rounded(ci: DataFrame) -> DataFrame:
    return ci.select(*[F.round(c, 6).alias(c) if c in ("lo", "hi") else F.col(c) for c in ci.columns])


@query(sql("frames", ", un as (select session_id, sum(value) as vw, count(*) as w from frames where signal_name = 'surprise' group by all)" + _boot("un", "session_id", "sum(vw * times) / sum(w * times)") + _CI))
def agg_06_bootstrap_mean(spark, d):
    """Percentile interval of the weighted mean of surprise over resampled sessions."""
    u = v.frames(spark, d).where("signal_name = 'surprise'").groupBy("session_id").agg(F.sum("value").alias("vw"), F.count(F.lit(1)).alias("w"))
    return _rounded(rs.interval(rs.bootstrap(u, "session_id", ["vw", "w"], rs.weighted_mean(), 200, SEED)))


_POISSON = " + ".join(f"(x >= {p!r})::int" for p in rs.POISSON)


@query(sql("frames", f""", un as (select session_id, sum(value) as vw, count(*) as w from frames where signal_name = 'surprise' group by all),
ea as (select b, vw, w, cast(('0x' || substr(sha256('{SEED}:' || b || ':' || session_id), 1, 16)) as ubigint)::double / 18446744073709551616.0 as x from un, (select unnest(range(100)) as b)),
va as (select b, sum(vw * ({_POISSON})) / sum(w * ({_POISSON})) as value from ea where x >= {rs.POISSON[0]!r} group by b)""" + _CI))
def agg_06_poisson_bootstrap(spark, d):
    """The same interval with Poisson weights: no numbering, no join."""
    u = v.frames(spark, d).where("signal_name = 'surprise'").groupBy("session_id").agg(F.sum("value").alias("vw"), F.count(F.lit(1)).alias("w"))
    return _rounded(rs.interval(rs.poisson_bootstrap(u, ["vw", "w"], rs.weighted_mean(), "session_id", 100, SEED)))


@query(sql("frames", ", un as (select session_id, sum(value) as vw, count(*) as w from frames where signal_name = 'surprise' group by all)" + _boot("un", "session_id", "sum(vw * times) / sum(w * times)") + ", r as (select value, row_number() over (order by value) - 1 as k from va) select round(max(value) filter (k = 5), 6) as lo, round(max(value) filter (k = 195), 6) as hi from r"))
def agg_39_index_interval(spark, d):
    u = v.frames(spark, d).where("signal_name = 'surprise'").groupBy("session_id").agg(F.sum("value").alias("vw"), F.count(F.lit(1)).alias("w"))
    return _rounded(rs.interval_by_index(rs.bootstrap(u, "session_id", ["vw", "w"], rs.weighted_mean(), 200, SEED), 200))


_LINES = _COUNTS + """, k as (select lineage_id, item, count(*) as m, count(*) filter (action = 'ack') as c1, count(*) filter (action = 'repair') as c2, count(*) filter (action = 'respond') as c3, count(*) filter (action = 'wait') as c4 from o group by all having count(*) >= 2),
un as (select lineage_id, count(*) as items, sum(m) as total, sum((m * m - c1 * c1 - c2 * c2 - c3 * c3 - c4 * c4) / (m - 1.0)) as disagreed, sum(c1) as t1, sum(c2) as t2, sum(c3) as t3, sum(c4) as t4 from k group by all)"""
_STAT = "1 - sum(disagreed * times) * (sum(total * times) - 1) / nullif(sum(total * times) * sum(total * times) - sum(t1 * times) * sum(t1 * times) - sum(t2 * times) * sum(t2 * times) - sum(t3 * times) * sum(t3 * times) - sum(t4 * times) * sum(t4 * times), 0)"


@query(sql("ratings", _LINES + _boot("un", "lineage_id", _STAT) + _CI))
def agg_21_lineage_bootstrap(spark, d):
    """Interval of alpha over resampled lineages, from additive sums per lineage."""
    sums = ag.alpha_sums(ag.item_counts(_originals(spark, d), ["lineage_id"]), ["lineage_id"])
    names = ["total", "disagreed", *[f"t_{c}" for c in ag.ACTIONS]]
    return _rounded(rs.interval(rs.bootstrap(sums, "lineage_id", names, ag.alpha_of(), 200, SEED)))


@query(sql("ratings", """, o as (select lineage_id, item, confidence, action from ratings where not is_repeat and confidence is not null), un as (select lineage_id, sum((confidence >= 4)::int) as a, sum((confidence >= 3)::int) as b_, count(*) as w from o group by all)""" + _boot("un", "lineage_id", "(sum(a * times) - sum(b_ * times)) / sum(w * times)") + _CI))
def agg_25_paired_delta(spark, d):
    """Paired difference of two rates over the same resampled lineages."""
    o = _originals(spark, d).where("confidence is not null")
    u = o.groupBy("lineage_id").agg(F.sum((F.col("confidence") >= 4).cast("int")).alias("a"), F.sum((F.col("confidence") >= 3).cast("int")).alias("b_"), F.count(F.lit(1)).alias("w"))
    return _rounded(rs.interval(rs.bootstrap(u, "lineage_id", ["a", "b_", "w"], F.try_divide(F.col("a") - F.col("b_"), F.col("w")), 200, SEED)))


_MAJORITY = """, p as (select item, raw_action, count(*) as n from ratings where not is_repeat group by all), g as (select item, sum(n) as n_ratings, coalesce(max(n) filter (raw_action = 'unratable'), 0) as u from p group by all),
b as (select item, raw_action from p where raw_action <> 'unratable' and n >= 2 qualify row_number() over (partition by item order by n desc, raw_action desc) = 1),
mj as (select item, cast(n_ratings as bigint) as n_ratings, case when u >= 2 then 'excluded' when b.raw_action is not null then 'resolved' else 'unresolved' end as outcome, case when u < 2 then b.raw_action end as action from g left join b using (item))"""


@query(sql("ratings", _MAJORITY + " select * from mj"))
def agg_35_majority(spark, d):
    return ag.majority(_originals(spark, d))


@query(sql("ratings", """ select item, round(count(*) filter (action = 'ack') / nullif(count(action), 0), 6) as p_ack, round(count(*) filter (action = 'repair') / nullif(count(action), 0), 6) as p_repair,
  round(count(*) filter (action = 'respond') / nullif(count(action), 0), 6) as p_respond, round(count(*) filter (action = 'wait') / nullif(count(action), 0), 6) as p_wait, round(avg(confidence), 6) as confidence from ratings where not is_repeat group by item"""))
def agg_36_distribution(spark, d):
    out = ag.distribution(_originals(spark, d))
    return out.select("item", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(sql("ratings", _MAJORITY + " select outcome, action, count(*) as n from mj group by all"))
def agg_33_outcomes(spark, d):
    return ag.majority(_originals(spark, d)).groupBy("outcome", "action").agg(F.count(F.lit(1)).alias("n"))


@query(sql("ratings", """, o as (select * from ratings where not is_repeat), c as (select item, count(action) as m from o group by all)
select count(*) as items, round(avg((m >= 2)::int), 6) as pairable, (select count(distinct lineage_id) from o) as lineages, (select max(k) from (select count(distinct item) as k from o group by lineage_id)) as most_per_lineage from c"""))
def agg_34_coverage(spark, d):
    """Share of pairable items, lineages, and the most items of one lineage."""
    o = _originals(spark, d)
    c = o.groupBy("item").agg(F.count("action").alias("m")).agg(F.count(F.lit(1)).alias("items"), F.round(F.avg((F.col("m") >= 2).cast("int")), 6).alias("pairable"))
    li = o.groupBy("lineage_id").agg(F.count_distinct("item").alias("k")).agg(F.count(F.lit(1)).alias("lineages"), F.max("k").alias("most_per_lineage"))
    return c.crossJoin(li)  # one row each


@query("""with a as (select distinct assignment_id, lower(replace(trim(annotator_id), '_', '-')) as annotator_id from assigned_annotations)
select count(*) as joined, count(*) filter (a.annotator_id <> m.annotator_id) as other_annotator, (select count(*) from a anti join assignment_map using (assignment_id)) as unknown from a join assignment_map m using (assignment_id)""")
def join_11_foreign_key(spark, d):
    """Answers against the map: matches, mismatched annotators, unknown assignments."""
    a = table(spark, d, "assigned_annotations").select("assignment_id", F.regexp_replace(tidy("annotator_id"), "_", "-").alias("annotator_id")).distinct()
    m = table(spark, d, "assignment_map").select("assignment_id", F.col("annotator_id").alias("asked"))
    j = a.join(m, "assignment_id", "left")
    return j.agg(F.count("asked").alias("joined"), F.count(F.when(F.col("asked") != F.col("annotator_id"), 1)).alias("other_annotator"), F.count(F.when(F.col("asked").isNull(), 1)).alias("unknown"))


@query("""with a as (select distinct assignment_id from assigned_annotations), m as (select distinct assignment_id from assignment_map)
select assignment_id, 'missing' as side from m anti join a using (assignment_id) union all select assignment_id, 'unexpected' from a anti join m using (assignment_id)""")
def join_13_coverage(spark, d):
    """Anti joins both ways (JOIN-13, JOIN-16, SET-02)."""
    return va.coverage(table(spark, d, "assignment_map"), table(spark, d, "assigned_annotations"), ["assignment_id"])


@query(sql("ratings", """, o as (select item, annotator, action from ratings where not is_repeat and action is not null)
select x.action as a, y.action as b, count(*) as pairs from o x join o y on x.item = y.item and x.annotator < y.annotator group by all"""))
def join_14_rater_pairs(spark, d):
    """Unordered pairs of raters of an item, by their actions. Items hold few raters, so the join stays linear."""
    o = _originals(spark, d).where("action is not null").select("item", "annotator", "action")
    b = o.select("item", F.col("annotator").alias("other"), F.col("action").alias("b"))
    return o.join(b, "item").where("annotator < other").groupBy(F.col("action").alias("a"), "b").agg(F.count(F.lit(1)).alias("pairs"))


@query(sql("ratings", _MAJORITY + """, e as (select item, min(action) as decided from ratings where action is not null group by all)
select mj.item, e.decided from mj join e using (item) where outcome = 'unresolved' and exists (select 1 from ratings r where r.item = mj.item and r.action = e.decided)"""))
def join_17_decisions(spark, d):
    """Decisions on unresolved items whose action somebody gave: semi joins both ways."""
    r = v.ratings(spark, d)
    decided = r.where("action is not null").groupBy("item").agg(F.min("action").alias("decided"))
    open_ = ag.majority(_originals(spark, d)).where("outcome = 'unresolved'")
    given = r.select("item", F.col("action").alias("decided")).distinct()
    return decided.join(open_, "item", "left_semi").join(given, ["item", "decided"], "left_semi")


@query(sql("checkpoints", """ select m.item_id, case when m.lineage_id is distinct from c.lineage_id then 'lineage_id' else 'source' end as "column"
from (select distinct item_id, lineage_id, source from assignment_map) m join (select checkpoint_id as item_id, min(lineage_id) as lineage_id, min(source) as source from cp group by all) c using (item_id)
where m.lineage_id is distinct from c.lineage_id or m.source is distinct from c.source"""))
def join_18_mismatches(spark, d):
    m = table(spark, d, "assignment_map").select("item_id", "lineage_id", "source").distinct()
    c = v.checkpoints(spark, d).groupBy(F.col("checkpoint_id").alias("item_id")).agg(F.min("lineage_id").alias("lineage_id"), F.min("source").alias("source"))
    return va.mismatches(m, c, ["item_id"], ["lineage_id", "source"])


_SHARE = "cast(('0x' || substr(sha256({0}), 1, 16)) as ubigint)::double / 18446744073709551616.0"


@query(f"""with l as (select distinct lineage_id, {_SHARE.format("'7:' || lineage_id")} as x from sessions)
select lineage_id, case when x < 0.7 then 'train' when x < 0.85 then 'validation' else 'test' end as split from l""")
def smp_01_hash_split(spark, d):
    return table(spark, d, "sessions").select("lineage_id").distinct().select("lineage_id", sp.hash_split(7, "lineage_id").alias("split"))


@query(f"select distinct session_id, case when challenge then 'challenge' when {_SHARE.format(chr(39) + '7:' + chr(39) + ' || lineage_id')} < 0.5 then 'a' else 'b' end as arm from sessions")
def smp_01_challenge(spark, d):
    s = table(spark, d, "sessions")
    return s.select("session_id", F.when(F.col("challenge"), "challenge").when(hash_share(F.lit(7), "lineage_id") < 0.5, "a").otherwise("b").alias("arm")).distinct()


@query(sql("checkpoints", """, e as (select distinct lineage_id, episode_id from cp where lineage_id is not null and episode_id is not null),
r as (select *, row_number() over (partition by lineage_id order by sha256('5:' || lineage_id || ':' || episode_id), episode_id) as k from e)
select cp.checkpoint_id, cp.lineage_id, cp.episode_id from cp join r using (lineage_id, episode_id) where k <= 3"""))
def topk_01_per_lineage(spark, d):
    """Whole episodes: the three of each lineage that a hash ranks first."""
    c = v.checkpoints(spark, d).select("checkpoint_id", "lineage_id", "episode_id").where("lineage_id is not null and episode_id is not null")
    return sp.top_groups(c, "lineage_id", "episode_id", 3, 5).select("checkpoint_id", "lineage_id", "episode_id")


_PILOT = {"size": 75, "min_lineages": 5, "seed": 11}


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Joint silences of lineages in the allowed splits: item, episode (with its session), lineage, source, stratum, elapsed."""
    c = v.checkpoints(spark, d).where("elapsed_s >= 0 and lineage_id is not null and source is not null and session_id is not null and context = 'joint_silence'")
    c = c.where(sp.hash_split(11, "lineage_id").isin("train", "validation"))
    stratum = F.when(F.col("elapsed_s") < 1, "a").when(F.col("elapsed_s") < 3, "b").otherwise("c")
    first = c.groupBy("checkpoint_id").agg(F.min(F.struct("lineage_id", "source", "elapsed_s", "session_id", "episode_id")).alias("r")).select("checkpoint_id", "r.*")
    return first.select(F.col("checkpoint_id").cast("string").alias("item"), F.concat_ws("/", "session_id", "episode_id").alias("episode"), F.col("lineage_id").alias("lineage"), "source", stratum.alias("stratum"), F.col("elapsed_s").alias("elapsed"))


@query()
def topk_02_pilot(spark, d):
    return sp.balanced_pilot(_candidates(spark, d), **_PILOT)


@query(sql("checkpoints", """, c as (select checkpoint_id, min(struct_pack(lineage_id, source, elapsed_s, session_id, episode_id)) as r from cp
    where elapsed_s >= 0 and lineage_id is not null and source is not null and session_id is not null and context = 'joint_silence'
      and cast(('0x' || substr(sha256('11:' || lineage_id), 1, 16)) as ubigint)::double / 18446744073709551616.0 < 0.85 group by all),
e as (select count(distinct r.session_id || '/' || r.episode_id) as n, count(distinct r.lineage_id) as l from c)
select least(75, n) as n_items, least(75, n) as n_episodes, true as enough_lineages, 0 as n_outside from e"""))
def topk_02_constraints(spark, d):
    """What the pilot has to keep: its size, one item per episode, enough lineages, nothing that was no candidate."""
    c = _candidates(spark, d)
    picked = sp.balanced_pilot(c, **_PILOT, partial=True).join(c.select("item", F.lit(1).alias("known")), "item", "left")
    return picked.agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("episode").alias("n_episodes"), (F.count_distinct("lineage") >= _PILOT["min_lineages"]).alias("enough_lineages"), F.count(F.when(F.col("known").isNull(), 1)).cast("int").alias("n_outside"))


def _pool(pilot: DataFrame, per_item: int) -> list[str]:
    """Annotators enough to keep every lineage's items apart."""
    most = pilot.groupBy("lineage").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    return [f"ann-{i:02d}" for i in range(1, max(8, per_item * most) + 1)]


@query()
def smp_02_assign(spark, d):
    pilot = sp.balanced_pilot(_candidates(spark, d), **_PILOT, partial=True)
    return sp.assign(pilot.select("item", "lineage"), _pool(pilot, 3), 3, 11)


@query("select 0 as n_shared, 0 as n_wrong_size, true as even")
def smp_02_constraints(spark, d):
    """Annotators with two items of a lineage (none), items without three annotators (none), loads that differ by at most a lineage's items."""
    pilot = sp.balanced_pilot(_candidates(spark, d), **_PILOT, partial=True)
    got = sp.assign(pilot.select("item", "lineage"), _pool(pilot, 3), 3, 11).join(pilot.select("item", "lineage"), "item")
    shared = got.groupBy("annotator", "lineage").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).cast("int").alias("n_shared"))
    sizes = got.groupBy("item").agg(F.count_distinct("annotator").alias("n")).where("n <> 3").agg(F.count(F.lit(1)).cast("int").alias("n_wrong_size"))
    most = pilot.groupBy("lineage").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    loads = got.groupBy("annotator").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") - F.min("n")).alias("spread"))
    return shared.crossJoin(sizes).crossJoin(loads.crossJoin(most).select((F.col("spread") <= F.col("most")).alias("even")))  # one row each


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assignment_map").where("not is_repeat").select(F.col("item_id").cast("string").alias("item"), F.col("annotator_id").alias("annotator")).distinct()


@query("""with a as (select distinct cast(item_id as varchar) as item, annotator_id as annotator from assignment_map where not is_repeat),
r as (select *, count(*) over (partition by annotator) as n, row_number() over (partition by annotator order by sha256('11:' || annotator || ':' || item)) as k from a)
select item, annotator, false as is_repeat from r union all select item, annotator, true from r where k <= greatest(1, floor(n * 0.05 + 0.5))""")
def smp_03_repeats(spark, d):
    return sp.with_repeats(_assigned(spark, d), 0.05, 11)


@query()
def smp_04_queue(spark, d):
    e = v.checkpoints(spark, d).groupBy(F.col("checkpoint_id").cast("string").alias("item")).agg(F.min(F.concat_ws("/", "session_id", "episode_id")).alias("episode"))
    return sp.spaced_queue(_assigned(spark, d).join(e, "item"), 11)


@query(sql("checkpoints", """, c as (select checkpoint_id, min(lineage_id) as g, min(elapsed_s) as x from cp where lineage_id is not null and elapsed_s is not null group by all),
a as (select *, row_number() over (partition by g order by checkpoint_id) as k from c), b as (select g, x as x_shuffled, row_number() over (partition by g order by sha256('3:' || checkpoint_id), checkpoint_id) as k from c)
select checkpoint_id, g, x, x_shuffled from a join b using (g, k)"""))
def smp_05_shuffle_within(spark, d):
    c = v.checkpoints(spark, d).where("lineage_id is not null and elapsed_s is not null").groupBy("checkpoint_id").agg(F.min("lineage_id").alias("g"), F.min("elapsed_s").alias("x"))
    return sp.shuffled_within(c, ["g"], "checkpoint_id", "x", 3)


@query("select session_id, count(*) as n from sessions group by all having count(*) > 1")
def val_01_duplicates(spark, d):
    return va.duplicates(table(spark, d, "sessions"), ["session_id"])


@query(sql("checkpoints", " select session_id, count(distinct coalesce(lineage_id, chr(0))) as lineage_id, count(distinct coalesce(source, chr(0))) as source from cp group by all having count(distinct coalesce(lineage_id, chr(0))) > 1 or count(distinct coalesce(source, chr(0))) > 1"))
def val_02_dependencies(spark, d):
    return va.broken_dependencies(v.checkpoints(spark, d), "session_id", ["lineage_id", "source"])


@query("select item_id, count(*) as n from assignment_map where not is_repeat group by all having count(*) not between 5 and 5")
def val_03_raters(spark, d):
    return va.wrong_counts(table(spark, d, "assignment_map").where("not is_repeat"), "item_id", 5, 5)


@query(sql("ratings", """, rt as (select assignment_id, ratable from assigned_annotations qualify row_number() over (partition by assignment_id order by submitted_at desc nulls last, lower(trim(action)) desc) = 1), r as (select assignment_id, [case when not coalesce(raw_action in ('ack', 'repair', 'respond', 'wait', 'unratable'), false) then 'action' end, case when not coalesce(confidence between 1 and 5, false) then 'confidence' end,
  case when not coalesce(coalesce(waits, false) or earliest is null or earliest <= latest, false) then 'onset' end, case when not coalesce(ratable = (raw_action <> 'unratable'), false) then 'ratable' end] as x from ratings join rt using (assignment_id))
select assignment_id, rule from (select assignment_id, unnest(x) as rule from r) where rule is not null"""))
def val_04_rules(spark, d):
    rules = {
        "action": F.col("raw_action").isin(*ag.ACTIONS, "unratable"),
        "confidence": F.col("confidence").between(1, 5),
        "onset": F.coalesce("waits", F.lit(False)) | F.col("earliest").isNull() | (F.col("earliest") <= F.col("latest")),
        "ratable": F.col("ratable") == (F.col("raw_action") != "unratable"),
    }
    a = table(spark, d, "assigned_annotations").select("assignment_id", "submitted_at", tidy("action").alias("action"), "ratable")
    last = a.groupBy("assignment_id").agg(F.max_by("ratable", F.struct("submitted_at", "action")).alias("ratable"))
    return va.rule_breaks(v.ratings(spark, d).join(last, "assignment_id"), ["assignment_id"], rules)


@query(sql("checkpoints", " select checkpoint_id, 'timing' as rule from cp where not coalesce(abs(model_cutoff_s - onset_s - elapsed_s) <= 1e-6, false) union all select checkpoint_id, 'grid' from cp where not coalesce(elapsed_s in (0.24, 0.48, 0.96, 2, 3, 5, 10), false)"))
def val_06_timing(spark, d):
    rules = {"timing": F.abs(F.col("model_cutoff_s") - F.col("onset_s") - F.col("elapsed_s")) <= 1e-6, "grid": F.col("elapsed_s").isin(0.24, 0.48, 0.96, 2.0, 3.0, 5.0, 10.0)}
    return va.rule_breaks(v.checkpoints(spark, d), ["checkpoint_id"], rules)


@query(sql("checkpoints", " select source, count(distinct checkpoint_id) as items, count(distinct lineage_id) as lineages, count(distinct session_id) as sessions from cp group by all"))
def val_07_sizes(spark, d):
    return v.checkpoints(spark, d).groupBy("source").agg(F.count_distinct("checkpoint_id").alias("items"), F.count_distinct("lineage_id").alias("lineages"), F.count_distinct("session_id").alias("sessions"))


@query(sql("checkpoints", " select count(*) as leaked from (select lineage_id from cp where context = 'joint_silence' intersect select lineage_id from sessions where challenge)"))
def val_09_protected(spark, d):
    """Lineages that a protected split and the sample share."""
    a = v.checkpoints(spark, d).where("context = 'joint_silence'").select("lineage_id")
    return a.intersect(table(spark, d, "sessions").where("challenge").select("lineage_id")).agg(F.count(F.lit(1)).alias("leaked"))


@query(sql("checkpoints", " select checkpoint_id, source, lineage_id, quality from cp where context = 'joint_silence' and quality = 'clean' and elapsed_s is not null"))
def flt_08_eligible(spark, d):
    """Context, quality and split as plain predicates (FLT-08, FLT-09)."""
    return v.checkpoints(spark, d).where("context = 'joint_silence' and quality = 'clean' and elapsed_s is not null").select("checkpoint_id", "source", "lineage_id", "quality")


@query(sql("ratings", " select assignment_id, earliest, latest, waits, action from ratings where coalesce(waits, earliest <= latest)"))
def prj_13_onset_struct(spark, d):
    """Onset as a struct, unratable as null (PRJ-12, PRJ-13)."""
    r = v.ratings(spark, d).select("assignment_id", F.struct("earliest", "latest", "waits").alias("onset"), "action")
    return r.where(F.coalesce("onset.waits", F.col("onset.earliest") <= F.col("onset.latest"))).select("assignment_id", "onset.*", "action")


@query(sql("ratings", " select annotator, sha256('blind' || chr(0) || annotator) as opaque, count(*) as n from ratings group by all"))
def hash_01_opaque(spark, d):
    r = v.ratings(spark, d).groupBy("annotator").agg(F.count(F.lit(1)).alias("n"))
    return r.select("annotator", F.sha2(F.concat(F.lit("blind"), F.lit("\u0000"), "annotator"), 256).alias("opaque"), "n")


@query(sql("ratings", " select item, count(*) filter (quality = 'clean') as clean, count(*) filter (quality = 'noise_or_clipping') as noise, count(*) filter (list_contains(tags, 'hesitation')) as hesitation from ratings group by all"))
def map_02_counters(spark, d):
    r = v.ratings(spark, d)
    hit = lambda c: F.count(F.when(c, 1))
    return r.groupBy("item").agg(hit(F.col("quality") == "clean").alias("clean"), hit(F.col("quality") == "noise_or_clipping").alias("noise"), hit(F.array_contains("tags", "hesitation")).alias("hesitation"))


QUERIES = Q
