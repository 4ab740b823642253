"""Queries on checked sources, weights, frame ids, opaque ids, gates and receipts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.columns import finite, half_even, tidy
from turnloom.operators import agreement as ag
from turnloom.operators import numerics as nu
from turnloom.operators import protocols as pr
from turnloom.operators import resample as rs
from turnloom.operators import sampling as sp
from turnloom.operators import validation as va
from turnloom.plans import views as v
from turnloom.plans.annotation import _STAT, SEED, _boot, _LINES, _originals
from turnloom.plans.views import sql
from turnloom.runtime import place, table
from turnloom.sources import strict as st
from turnloom.sources import weights as wt
from turnloom.sources import writers as wr

Q: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


_SPEECH = """s as (select session_id, min(lineage_id) as lineage_id, min(source) as source, min(duration_s) as duration_s from sessions group by all),
t as (select distinct session_id, lower(trim(speaker, E' \\t\\n\\r')) as channel, start_s, end_s from transcript_turns where start_s is not null and end_s is not null and not isnan(start_s) and not isnan(end_s) and not isinf(start_s) and not isinf(end_s)),
u as (select t.*, duration_s from t join s using (session_id) where channel in ('user', 'assistant')),
o as (select *, lead(start_s) over (partition by session_id, channel order by start_s, end_s) as following from u),
bad as (select session_id, 'duration_s' as rule from s where not coalesce(duration_s > 0, false)
  union select session_id, channel || ' range' from o where start_s < 0 or end_s > duration_s
  union select session_id, channel || ' order' from o where start_s >= end_s
  union select session_id, channel || ' overlap' from o where following < end_s)"""


def _speech(spark: SparkSession, d: str) -> str:
    """Sessions with the speech of both channels as JSON lines, the user's as pairs, the assistant's as objects."""
    s = table(spark, d, "sessions").groupBy("session_id").agg(*[F.min(c).alias(c) for c in ("lineage_id", "source", "duration_s")])
    t = table(spark, d, "transcript_turns").select("session_id", tidy("speaker").alias("channel"), finite("start_s").alias("start_s"), finite("end_s").alias("end_s")).dropna().distinct()
    side = lambda c, x: F.coalesce(F.collect_list(F.when(F.col("channel") == c, x)), F.array())
    lists = t.where("channel in ('user', 'assistant')").groupBy("session_id").agg(side("user", F.array("start_s", "end_s")).alias("user_vad"), side("assistant", F.struct("start_s", "end_s")).alias("right"))
    path = place(spark, "speech")
    out = s.join(lists, "session_id", "left").withColumn("user_vad", F.coalesce("user_vad", F.array())).withColumn("right", F.coalesce("right", F.array()))
    out.write.json(path)
    return path


@query("with " + _SPEECH + " select session_id, rule from bad")
def src_17_broken_speech(spark, d):
    """Sessions whose speech breaks the strict rules, with the rule (SRC-17)."""
    return st.strict_vad(spark, _speech(spark, d))[2]


@query("with " + _SPEECH + " select channel, count(*) as n, round(sum(end_s - start_s), 6) as seconds from u anti join bad using (session_id) group by all")
def src_17_strict_speech(spark, d):
    """Speech of the sessions that break nothing."""
    i = st.strict_vad(spark, _speech(spark, d))[1]
    return i.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("end_s") - F.col("start_s")), 6).alias("seconds"))


@query("with a as (select distinct assignment_id, annotator_id, action, quality from assigned_annotations) select rule, count(*) as n from (select case when not coalesce(action in ('wait', 'ack', 'respond', 'repair', 'unratable'), false) then 'action' else 'fine' end as rule from a) group by all")
def src_18_label_lines(spark, d):
    """Labels written as lines and read with line numbers; how many break which rule."""
    a = table(spark, d, "assigned_annotations").select(F.concat_ws("/", "assignment_id", F.coalesce("action", F.lit("")), F.coalesce("quality", F.lit(""))).alias("episode_id"), F.col("annotator_id").alias("annotator"), "action", "quality").distinct()
    path = place(spark, "labels")
    a.select(F.to_json(F.struct("*"))).write.text(path)
    good, broken = st.label_lines(spark, path)
    return good.select(F.lit("fine").alias("rule")).unionByName(broken.select("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with n as (select distinct session_id as name from chunk_signals), a as (select distinct session_id from turn_events where session_id is not null),
k as (select session_id, name, row_number() over (partition by session_id order by name <> session_id, name) as i from a join n on {v._ID.replace("session_id", "a.session_id")} = {v._ID.replace("session_id", "n.name")})
select a.session_id, name from a left join (select * from k where i = 1) using (session_id)""")
def join_02_resolved(spark, d):
    """Each session id of the events with the id of the series it resolves to: the same one, or else the first alias (JOIN-02)."""
    names = table(spark, d, "chunk_signals").select(F.col("session_id").alias("name")).where("name is not null").distinct()
    return st.resolved(table(spark, d, "turn_events").select("session_id").where("session_id is not null").distinct(), names)


@query(sql("frames", f""", s as (select distinct session_id from sessions), f as (select session_id, count(*) as n from frames where signal_name = 'p_shift' group by all)
select s.session_id, case when n is not null then 'dc_' || f.session_id end as name, cast(n * 8 + 128 as bigint) as n_bytes from s left join f on {v._ID.replace("session_id", "s.session_id")} = f.session_id"""))
def src_13_resolved_files(spark, d):
    """Sessions with the file that an alias of theirs names, found by listing the folder (SRC-13)."""
    base = place(spark, "named")
    series = wr.nested_series(v.frames(spark, d).where("signal_name = 'p_shift'"), "value", "values")
    wr.save_arrays(series.select(F.concat(F.lit("dc_"), "session_id").alias("name"), "values"), base)
    return st.resolved(table(spark, d, "sessions").select("session_id").distinct(), st.named_files(spark, base, ".npy")).select("session_id", "name", "n_bytes")


@query("select distinct chunk_id, cast(round_even(t_end / 0.08, 0) as bigint) as frame from chunk_signals where t_end is not null and not isnan(t_end) and not isinf(t_end)")
def prj_10_frame_ids(spark, d):
    """Frame of each point from its end time, half to even (PRJ-10)."""
    c = table(spark, d, "chunk_signals").select("chunk_id", finite("t_end").alias("t_end")).where("t_end is not null")
    return c.select("chunk_id", half_even(F.col("t_end") / 0.08).alias("frame")).distinct()


@query(sql("vectors", """ select session_id, frame, round(list_sum([vec[i] * i / 1000.0 for i in range(1, 65)]) + 1, 6) as a, round(list_sum([vec[i] * i * 2 / 1000.0 for i in range(1, 65)]) + 2, 6) as b from vectors"""))
def src_15_loaded_weights(spark, d):
    """A network saved with its matrix turned, found as the newest file, loaded, and run on every frame (SRC-15, SNK-04, SRT-03)."""
    base = place(spark, "weights")
    m = np.outer(np.arange(1, 65), [1.0, 2.0]) / 1000.0
    wt.save_weights([(np.zeros((64, 2)), np.zeros(2))], f"{base}/step9.npz")
    wt.save_weights([(m.T, np.array([1.0, 2.0]))], f"{base}/step10.npz")
    layers = wt.load_weights(wt.newest(base), 64)
    out = nu.predicted(v.vectors(spark, d).select("session_id", "frame", "vec"), layers, "vec")
    return out.select("session_id", "frame", F.round(F.col("pred")[0], 6).alias("a"), F.round(F.col("pred")[1], 6).alias("b"))


@query("""select session_id, episode_id, row_number() over (partition by session_id order by cast(regexp_extract(episode_id, '^e(\\d+)', 1) as bigint), cast(regexp_extract(episode_id, '-(\\d+)$', 1) as bigint)) as place
from (select distinct session_id, episode_id from silence_checkpoints where regexp_full_match(episode_id, 'e\\d+-\\d+'))""")
def srt_03_natural_order(spark, d):
    """Episodes of a session in natural order: e2-010 before e10-002 (SRT-03)."""
    from pyspark.sql import Window

    c = table(spark, d, "silence_checkpoints").where(F.regexp_like("episode_id", F.lit(r"^e\d+-\d+$"))).select("session_id", "episode_id").distinct()
    return c.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(st.natural("episode_id"))))


@query("select unnest([1, 12, 62]) as horizon_frames, unnest([80, 960, 4960]) as horizon_ms")
def src_16_selection_lock(spark, d):
    """Horizons of a selection lock with a nested grid (SRC-16)."""
    grid = st.horizons_of('{"lambda": 0.01, "horizons": {"H_set": [12, 1], "H": 62}}')
    return spark.createDataFrame([(h, h * 80) for h in grid], "horizon_frames int, horizon_ms int")


_SPLIT = "case when x < 0.70 then 'train' when x < 0.85 then 'validation' else 'test' end"
_ARCHIVE = f""", a as (select checkpoint_id, min(lineage_id) as lineage_id, min(onset_s) as onset_s, min(elapsed_s) as elapsed_s, min(model_cutoff_s) as cutoff from cp where lineage_id is not null group by all),
h as (select *, cast(('0x' || substr(sha256('5:' || lineage_id), 1, 16)) as ubigint)::double / 18446744073709551616.0 as x from a)"""


@query(sql("checkpoints", _ARCHIVE + f""" select checkpoint_id as row_id, 'causal' as rule from h where not coalesce(onset_s + elapsed_s <= cutoff + 1e-9, false)
union all select checkpoint_id, 'split' from h where {_SPLIT} <> 'train' and checkpoint_id % 7 = 0 union all select checkpoint_id, 'acoustic finite' from h where elapsed_s is null or onset_s is null or isnan(onset_s) or isinf(onset_s)"""))
def src_20_archive_checks(spark, d):
    """A feature archive against its rules: finite vectors of one width, causal, lineages in their split (SRC-20). Every seventh row is filed as train."""
    c = v.checkpoints(spark, d).where("lineage_id is not null").groupBy("checkpoint_id").agg(*[F.min(x).alias(x) for x in ("lineage_id", "onset_s", "elapsed_s", "model_cutoff_s")])
    split = sp.hash_split(5, "lineage_id")
    archive = c.select(
        F.col("checkpoint_id").alias("row_id"), "lineage_id", F.when(F.col("checkpoint_id") % 7 == 0, F.lit("train")).otherwise(split).alias("split"), (F.col("onset_s") + F.col("elapsed_s")).alias("available_at_s"), "model_cutoff_s", F.array("onset_s", "elapsed_s").alias("acoustic")
    )
    path = place(spark, "archive")
    archive.write.parquet(path)
    splits = c.select("lineage_id").distinct().withColumn("split", split)
    return st.archive_breaks(spark.read.parquet(path), splits, ["acoustic"])


KEY = b"blinding key of the tests"


def _hex(pad: int) -> str:
    return bytes(b ^ pad for b in KEY.ljust(64, b"\x00")).hex()


def keyed(domain: str, c: str) -> Column:
    """HMAC-SHA256 of domain, NUL and id, in the JVM: two sha256 over the padded key (no longer than 64 bytes)."""
    inner = F.sha2(F.concat(F.unhex(F.lit(_hex(0x36))), F.concat(F.lit(domain + "\x00"), c).cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(_hex(0x5C))), F.unhex(inner)), 256)


@query(sql("ratings", f" select annotator, sha256(unhex('{_hex(0x5C)}') || unhex(sha256(unhex('{_hex(0x36)}') || unhex('{b'annotator'.hex()}00') || encode(annotator)))) as opaque, count(*) as n from ratings group by all"))
def hash_01_keyed(spark, d):
    """Opaque ids that can't be guessed without the key: HMAC-SHA256 of the domain and the id, joined by NUL (HASH-01)."""
    return v.ratings(spark, d).groupBy("annotator").agg(F.count(F.lit(1)).alias("n")).select("annotator", keyed("annotator", "annotator").alias("opaque"), "n")


@query("select distinct annotator_id as annotator, cast(('0x' || substr(sha256('seed:' || annotator_id), 1, 8)) as bigint) as seed from assignment_map")
def rnd_01_seeds(spark, d):
    """A seed per annotator: the first four bytes of sha256 (RND-01)."""
    a = table(spark, d, "assignment_map").select(F.col("annotator_id").alias("annotator")).distinct()
    return a.withColumn("seed", F.conv(F.substring(F.sha2(F.concat(F.lit("seed:"), "annotator"), 256), 1, 8), 16, 10).cast("bigint"))


@query()
def rnd_01_permuted(spark, d):
    """Each annotator's items in the order that numpy's PCG64 gives under the annotator's seed (RND-01). A queue is what one person can answer."""
    a = table(spark, d, "assignment_map").where("not is_repeat").select(F.col("annotator_id").alias("annotator"), F.col("item_id").alias("item")).distinct()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        pdf["place"] = pr.permutation(len(pdf), "queue", pdf["annotator"].iloc[0])
        return pdf[["annotator", "item", "place"]]

    return a.groupBy("annotator").applyInPandas(work, "annotator string, item bigint, place bigint")


_WAVE = "[sin((cast(('0x' || substr(sha256(session_id), 1, 8)) as bigint) % 628) / 100.0::double + frame * k / 10.0::double) for k in range({0}, {1})]"


@query(sql("frames", f""", f as (select distinct session_id, frame from frames where signal_name = 'surprise'), w as (select *, {_WAVE.format(1, 5)} as a from f)
select session_id, frame, round(list_sum([(x - 1) * (x - 1) for x in a]) / 4, 6) as surprise from w"""))
def ml_11_stand_ins(spark, d):
    """Surprise of a stand-in model against constant targets, through the protocols (UDF-03, UDF-05, ML-11)."""

    class Ones:
        def targets(self, frames: DataFrame) -> DataFrame:
            return frames.select("session_id", "frame", F.array_repeat(F.lit(1.0), 4).alias("target"))

    f = v.frames(spark, d).where("signal_name = 'surprise'").select("session_id", "frame").distinct()
    return pr.surprise(pr.WaveModel(4), Ones(), f).select("session_id", "frame", F.round("surprise", 6).alias("surprise"))


#: What the agreement gate asks for (parameters of the protocol, here those that fit the test tables).
GATE = {"items": (60, 1_000_000), "lineages": 30, "most_per_lineage": 1_000_000, "pairable": 0.8, "alpha": 0.8, "valid": 0.95}


@query(sql("ratings", _LINES + _boot("un", "lineage_id", _STAT) + """, o2 as (select * from ratings where not is_repeat), c as (select item, lineage_id, count(action) as m from o2 group by all),
cov as (select count(*) as items, count(distinct lineage_id) as lineages, round(avg((m >= 2)::int), 6) as pairable, (select max(k) from (select count(*) as k from c group by lineage_id)) as most_per_lineage from c),
al as (select round(1 - sum(disagreed) * (sum(total) - 1) / nullif(sum(total) * sum(total) - sum(t1) * sum(t1) - sum(t2) * sum(t2) - sum(t3) * sum(t3) - sum(t4) * sum(t4), 0), 6) as alpha from un),
bo as (select count(value) / 200.0::double as valid from va),
g as (select *, items between 60 and 1000000 and lineages >= 30 and most_per_lineage <= 1000000 and pairable >= 0.8 and valid >= 0.95 as covered from cov, al, bo)
select items, lineages, pairable, most_per_lineage, alpha, valid, covered, covered and alpha >= 0.8 as passed from g"""))
def agg_34_gate(spark, d):
    """The agreement gate: coverage, caps, bootstrap validity and alpha, each against its threshold (AGG-34)."""
    o = _originals(spark, d)
    c = o.groupBy("item", "lineage_id").agg(F.count("action").alias("m"))
    most = c.groupBy("lineage_id").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("lineages"), F.max("k").alias("most_per_lineage"))
    cov = c.agg(F.count(F.lit(1)).alias("items"), F.round(F.avg((F.col("m") >= 2).cast("int")), 6).alias("pairable"))
    sums = ag.alpha_sums(ag.item_counts(o, ["lineage_id"]), ["lineage_id"])
    names = ["total", "disagreed", *[f"t_{a}" for a in ag.ACTIONS]]
    alpha = sums.agg(*[F.sum(n).alias(n) for n in names]).select(F.round(ag.alpha_of(), 6).alias("alpha"))
    valid = rs.bootstrap(sums, "lineage_id", names, ag.alpha_of(), 200, SEED).agg((F.count("value") / 200.0).alias("valid"))
    g = cov.crossJoin(most).crossJoin(alpha).crossJoin(valid)  # one row each
    covered = F.col("items").between(*GATE["items"]) & (F.col("lineages") >= GATE["lineages"]) & (F.col("most_per_lineage") <= GATE["most_per_lineage"]) & (F.col("pairable") >= GATE["pairable"]) & (F.col("valid") >= GATE["valid"])
    return g.select("items", "lineages", "pairable", "most_per_lineage", "alpha", "valid", covered.alias("covered"), (covered & F.coalesce(F.col("alpha") >= GATE["alpha"], F.lit(False))).alias("passed"))


@query(sql("ratings", _LINES.replace("un as (", "aa as (") + """, o3 as (select * from ratings where not is_repeat),
cc as (select lineage_id, item, count(*) filter (action = 'ack') as c1, count(*) filter (action = 'repair') as c2, count(*) filter (action = 'respond') as c3, count(*) filter (action = 'wait') as c4 from o group by all),
pp as (select lineage_id, """ + ", ".join(f"sum(c{i} * (c{i} - 1)) as d{i}, sum(c{i} * (c1 + c2 + c3 + c4 - c{i})) as x{i}" for i in range(1, 5)) + """ from cc group by all),
uu as (select lineage_id, count(*) as an, count(*) filter (raw_action = 'unratable') as ur from o3 group by all),
un as (select uu.lineage_id, an, ur, """ + ", ".join(f"coalesce({c}, 0) as {c}" for c in ["total", "disagreed", *[f"t{i}" for i in range(1, 5)], *[f"{k}{i}" for i in range(1, 5) for k in "dx"]]) + """ from uu left join aa using (lineage_id) left join pp using (lineage_id))""" + _boot("un", "lineage_id", "0") .replace("va as (select b, 0 as value", "va as (select b, sum(ur * times) / sum(an * times)::double as s0, " + _STAT + " as s1, " + ", ".join(f"2.0 * sum(d{i} * times) / nullif(2 * sum(d{i} * times) + 2 * sum(x{i} * times), 0) as s{i + 1}" for i in range(1, 5))) + ", lg as (select unnest(['unratable_rate', 'alpha', 'agreement_ack', 'agreement_repair', 'agreement_respond', 'agreement_wait']) as statistic, unnest([s0, s1, s2, s3, s4, s5]) as value from va) select statistic, round(quantile_cont(value, 0.025), 6) as lo, round(quantile_cont(value, 0.975), 6) as hi, count(value) as n_valid from lg group by all"))
def agg_23_statistics(spark, d):
    """Intervals of the inter-rater statistics over resampled lineages, all from the same draws and additive sums (AGG-23)."""
    o = _originals(spark, d)
    items = ag.item_counts(o, ["lineage_id"])
    sums = ag.alpha_sums(items, ["lineage_id"])
    own = [F.sum(F.col(f"c_{a}") * (F.col(f"c_{a}") - 1)).alias(f"d_{a}") for a in ag.ACTIONS]
    other = [F.sum(F.col(f"c_{a}") * (F.col("m") - F.col(f"c_{a}"))).alias(f"x_{a}") for a in ag.ACTIONS]
    pairs = items.groupBy("lineage_id").agg(*own, *other)
    rates = o.groupBy("lineage_id").agg(F.count(F.lit(1)).alias("an"), F.count(F.when(F.col("raw_action") == "unratable", 1)).alias("ur"))
    unit = rates.join(sums.drop("items"), "lineage_id", "left").join(pairs, "lineage_id", "left").fillna(0)
    names = [c for c in unit.columns if c != "lineage_id"]
    stats = [("unratable_rate", F.try_divide(F.col("ur").cast("double"), F.col("an"))), ("alpha", ag.alpha_of())]
    stats += [(f"agreement_{a}", F.try_divide(2.0 * F.col(f"d_{a}"), 2 * F.col(f"d_{a}") + 2 * F.col(f"x_{a}"))) for a in ag.ACTIONS]
    every = F.array(*[F.struct(F.lit(n).alias("statistic"), s.cast("double").alias("value")) for n, s in stats])
    each = rs.bootstrap(unit, "lineage_id", names, every, 200, SEED).select("b", F.explode("value").alias("s")).select("b", "s.*")
    return rs.interval(each, ["statistic"]).select("statistic", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n_valid")


@query(sql("ratings", """, o as (select * from ratings where not is_repeat), c as (select item, source, stratum, count(action) as m, count(*) filter (action = 'ack') as c1, count(*) filter (action = 'repair') as c2, count(*) filter (action = 'respond') as c3, count(*) filter (action = 'wait') as c4 from o group by all),
k as (select *, greatest(c1, c2, c3, c4) as top from c)
select source, stratum, case when m = 0 then 'none' when 2 * top > m then 'majority' else 'open' end as outcome, count(*) as n from k group by all"""))
def agg_33_by_stratum(spark, d):
    """Outcomes of items by corpus and stratum (AGG-33)."""
    o = _originals(spark, d)
    c = o.groupBy("item", "source", "stratum").agg(F.count("action").alias("m"), *[F.count(F.when(F.col("action") == a, 1)).alias(f"c_{a}") for a in ag.ACTIONS])
    top = F.greatest(*[F.col(f"c_{a}") for a in ag.ACTIONS])
    return c.groupBy("source", "stratum", F.when(F.col("m") == 0, "none").when(2 * top > F.col("m"), "majority").otherwise("open").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_SUM = "cast(('0x' || substr(sha256({0}), 1, 10)) as bigint)"


@query("select 'sessions' as name, count(*) as n_rows, cast(sum(" + _SUM.format("""'{"lineage_id":"' || lineage_id || '","session_id":"' || session_id || '"}'""") + """) as bigint) as checksum, true as ok from (select session_id, lineage_id from sessions)
union all select 'assignment_map', count(*), cast(sum(""" + _SUM.format("""'{"annotator_id":"' || annotator_id || '","assignment_id":"' || assignment_id || '"}'""") + ") as bigint), true from assignment_map")
def val_08_receipts(spark, d):
    """Receipts of published tables (rows and an order-free checksum of canonical rows), recomputed from what is there (VAL-08)."""
    out = None
    for name, columns in (("sessions", ["session_id", "lineage_id"]), ("assignment_map", ["assignment_id", "annotator_id"])):
        t = table(spark, d, name).select(*columns)
        path = place(spark, "receipt")
        signed = wr.receipt({"name": name, **_checksum(t)}, KEY)
        wr.publish(t, path)
        again = _checksum(spark.read.parquet(path))
        ok = wr.verified(signed, KEY) and all(signed[k] == again[k] for k in again)
        row = spark.createDataFrame([(name, again["n_rows"], again["checksum"], ok)], "name string, n_rows bigint, checksum bigint, ok boolean")
        out = row if out is None else out.unionByName(row)
    return out


def _checksum(t: DataFrame) -> dict:
    h = F.conv(F.substring(F.sha2(wr.canonical(t), 256), 1, 10), 16, 10).cast("bigint")
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("bigint").alias("checksum")).first().asDict()


@query(sql("ratings", " select source, count(*) as n, count(*) filter (raw_action = 'unratable') as u, true as same from ratings where not is_repeat group by all"))
def val_08_recomputed(spark, d):
    """Counts of a written report beside whether the rows still give them (VAL-08)."""
    o = _originals(spark, d)
    path = place(spark, "report")
    counts = lambda df: df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("raw_action") == "unratable", 1)).alias("u"))
    counts(o).write.json(path)
    written = spark.read.schema("source string, n bigint, u bigint").json(path)
    wrong = va.mismatches(written, counts(o), ["source"], ["n", "u"])
    return written.join(wrong, "source", "left").select("source", "n", "u", F.col("column").isNull().alias("same"))


@query("""select distinct session_id, sha256('{"source":"' || source || '"}') as ascii_sha256 from sessions where source is not null and not regexp_matches(source, '[^ -~]')""")
def json_01_ascii_hash(spark, d):
    """The second canonical form: characters beyond ASCII escaped (JSON-01)."""
    import json

    @F.pandas_udf("string")
    def canonical(x: pd.Series) -> pd.Series:
        return x.map(lambda s: json.dumps({"source": s}, sort_keys=True, separators=(",", ":"), ensure_ascii=True))

    s = table(spark, d, "sessions").where("source is not null and not source rlike '[^ -~]'").select("session_id", "source").distinct()
    return s.select("session_id", F.sha2(canonical("source"), 256).alias("ascii_sha256")).distinct()


@query(sql("checkpoints", _ARCHIVE.replace("'5:'", "'11:'") + f", j as (select c.checkpoint_id, {_SPLIT} as split from cp c join h using (checkpoint_id) where context = 'joint_silence') select split, count(distinct checkpoint_id) as n from j where split in ('train', 'validation') group by all"))
def flt_08_allowed_splits(spark, d):
    """Joint silences whose lineage is in an allowed split (FLT-08, FLT-09)."""
    c = v.checkpoints(spark, d).where("lineage_id is not null")
    first = c.groupBy("checkpoint_id").agg(F.min("lineage_id").alias("lineage_id"))
    joint = c.where("context = 'joint_silence'").select("checkpoint_id").distinct().join(first, "checkpoint_id")
    return joint.withColumn("split", sp.hash_split(11, "lineage_id")).where(F.col("split").isin("train", "validation")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("select * from sample_targets")
def snk_06_package(spark, d):
    """A package of several tables that readers see only when all of it is there; a failed one leaves nothing (SNK-06)."""
    path = place(spark, "package")
    parts = {n: table(spark, d, n) for n in ("sample_targets", "mix_targets")}
    wr.publish_package(parts, path)
    return wr.read_package(spark, path, "sample_targets")


QUERIES = Q
