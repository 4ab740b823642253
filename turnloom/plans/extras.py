"""Further queries of the inventory: sources and sinks in both directions, small transforms, models, whole reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.functions import arrays as ar
from turnloom.functions.columns import finite, norm_session, tidy
from turnloom.operators import agreement as ag
from turnloom.operators import intervals as iv
from turnloom.operators import labels as lb
from turnloom.operators import metrics as mt
from turnloom.operators import numerics as nu
from turnloom.operators import synthetic as sy
from turnloom.operators import timeline as tl
from turnloom.operators import validation as va
from turnloom.operators.running import placed
from turnloom.plans import compare as cp
from turnloom.plans import views as v
from turnloom.plans.annotation import _COUNTS, _alpha
from turnloom.plans.timing import _EPISODES
from turnloom.plans.views import sql
from turnloom.runtime import place, table
from turnloom.sources import readers as rd
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


@query(f"""with e as (select event_id, session_id as raw, {v._ID} as normal from turn_events), s as (select distinct session_id from sessions)
select count(*) as n, count(a.session_id) as exact, count(b.session_id) as normal from e left join s a on e.raw = a.session_id left join s b on e.normal = b.session_id""")
def join_01_exact_or_normal(spark, d):
    """How many events find their session by the raw id, and by the normal one."""
    e = table(spark, d, "turn_events").select(F.col("session_id").alias("raw"), norm_session("session_id").alias("normal"))
    s = table(spark, d, "sessions").select("session_id").distinct()
    j = e.join(s.select(F.col("session_id").alias("raw"), F.lit(1).alias("a")), "raw", "left").join(s.select(F.col("session_id").alias("normal"), F.lit(1).alias("b")), "normal", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("exact"), F.count("b").alias("normal"))


@query(sql("frames", ", g as (select session_id, frame, value from frames where signal_name = 'surprise') select session_id, frame, value, kind, horizon from g, (select unnest(['turn_shift', 'backchannel', 'barge_in']) as kind), (select unnest([1, 12]) as horizon)"))
def join_15_grid(spark, d):
    f = v.frames(spark, d).where("signal_name = 'surprise'").select("session_id", "frame", "value")
    return lb.grid(f, ["turn_shift", "backchannel", "barge_in"], [1, 12])


@query(f"""with t as (select distinct turn_id, session_id, {v._SPEAKER} as speaker, {v._MS.format("start_s")} as a, {v._MS.format("end_s")} as b from transcript_turns) select turn_id, session_id, speaker, a as start_ms, b as end_ms from t where b > a""")
def flt_02_positive(spark, d):
    from turnloom.functions.columns import speaker_or_unknown, to_ms

    t = table(spark, d, "transcript_turns").select("turn_id", "session_id", speaker_or_unknown("speaker").alias("speaker"), to_ms("start_s").alias("start_ms"), to_ms("end_s").alias("end_ms")).distinct()
    return iv.positive(t)


@query(f"select chunk_id, {v._OK.format('signal_value')} as value, t_end from (select distinct chunk_id, signal_value, t_end from chunk_signals) where signal_value is not null and not isnan(signal_value) and t_end > 0 and not isnan(t_end)")
def flt_05_finite(spark, d):
    """Finite values with a positive finite weight."""
    c = table(spark, d, "chunk_signals").select("chunk_id", finite("signal_value").alias("value"), finite("t_end").alias("t_end")).distinct()
    return c.where("value is not null and t_end > 0")


@query(sql("turns", " select session_id, speaker, start_ms, end_ms, row_number() over (partition by session_id order by start_ms, end_ms, speaker) as place from turns"))
def srt_01_order(spark, d):
    return placed(v.turns(spark, d), ["session_id"], F.floor(F.col("start_ms") / iv.SLICE_MS), ["start_ms", "end_ms", "speaker"], "place")


@query(sql("frames", " select session_id, signal_name, frame, row_number() over (partition by session_id, signal_name order by value desc, frame) as rank from frames"))
def srt_02_stable_rank(spark, d):
    ranked = placed(v.frames(spark, d), ["session_id", "signal_name"], F.floor(-F.col("value") / mt.STEP), [F.desc("value"), "frame"], "rank")
    return ranked.select("session_id", "signal_name", "frame", "rank")


@query(f"select {v._ID} as session_id from chunk_signals except select {v._ID} from turn_events")
def set_02_without_events(spark, d):
    a, b = (table(spark, d, t).select(norm_session("session_id").alias("session_id")) for t in ("chunk_signals", "turn_events"))
    return a.subtract(b)


@query(sql("frames events", " select session_id, signal_name as name, count(*) as n from frames group by all union all select session_id, kind, count(*) from events_ group by all"))
def set_04_pool(spark, d):
    a = v.frames(spark, d).select("session_id", F.col("signal_name").alias("name"))
    b = v.events(spark, d).select("session_id", F.col("kind").alias("name"))
    return a.unionByName(b).groupBy("session_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("""with g as (select unnest([1, 12, 62]) as h, unnest([0.0, 0.01, 0.1]) as l), n as (select h, l, 'h' || h || '_lam' || case l when 0.0 then '0.00' when 0.01 then '0.01' else '0.10' end as name from g)
select name, cast(regexp_extract(name, '^h(\\d+)_lam', 1) as int) as h, cast(regexp_extract(name, '_lam(.*)$', 1) as double) as lam from n""")
def str_05_run_names(spark, d):
    g = spark.createDataFrame([(1, 0.0), (12, 0.01), (62, 0.1)], "h int, l double")
    n = g.select(F.format_string("h%d_lam%.2f", "h", "l").alias("name"))
    return n.select("name", F.regexp_extract("name", r"^h(\d+)_lam", 1).cast("int").alias("h"), F.regexp_extract("name", "_lam(.*)$", 1).cast("double").alias("lam"))


@query("select distinct checkpoint_id, cast(floor(onset_s * 16000 + 0.5) as bigint) as sample, round(ln(1 + silence_end_s - onset_s), 6) as log_silence, round(1 / (1 + exp(-(silence_end_s - onset_s))), 6) as squashed from silence_checkpoints where onset_s is not null and silence_end_s > onset_s")
def math_02_samples(spark, d):
    """Nearest sample by half up (MATH-02), log1p and sigmoid (MATH-04)."""
    c = table(spark, d, "silence_checkpoints").where("onset_s is not null and silence_end_s > onset_s")
    gap = F.col("silence_end_s") - F.col("onset_s")
    return c.select("checkpoint_id", F.floor(F.col("onset_s") * 16000 + 0.5).alias("sample"), F.round(F.log1p(gap), 6).alias("log_silence"), F.round(ar.sigmoid(gap), 6).alias("squashed")).distinct()


@query("""with s as (select distinct session_id, source, '{"session_id":"' || session_id || '","source":"' || source || '"}' as line from sessions) select session_id, sha256(line) as row_sha256 from s""")
def json_01_row_hash(spark, d):
    s = table(spark, d, "sessions").select("session_id", "source").distinct()
    return s.select("session_id", F.sha2(wr.canonical(s), 256).alias("row_sha256"))


@query("select distinct session_id, strftime(recorded_at, '%Y-%m-%dT%H:%M:%S') || 'Z' as iso, true as zoned from sessions")
def date_01_iso(spark, d):
    """Times as ISO text with a zone, and whether the text is one."""
    s = table(spark, d, "sessions").select("session_id", F.concat(F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("iso")).distinct()
    return s.withColumn("zoned", F.regexp_like("iso", F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$")))


@query(sql("ratings", """, p as (select item, count(*) filter (raw_action = 'ack') / count(*)::double as a, count(*) filter (raw_action = 'repair') / count(*)::double as b, count(*) filter (raw_action = 'respond') / count(*)::double as c from ratings group by all)
select item, case when c >= a and c >= b then 'respond' when b >= a and b >= c then 'repair' else 'ack' end as action, round(greatest(a, b, c), 6) as p from p"""))
def map_01_best_action(spark, d):
    """Likeliest action in play of a map of shares; of equal ones the greater name."""
    r = v.ratings(spark, d)
    per = r.groupBy("item").agg(F.collect_list("raw_action").alias("x"))
    counted = ar.counted("x", ["wait", "ack", "repair", "respond", "unratable"])
    best = ar.best_action(F.transform_values(counted, lambda k, n: n / F.size("x")), ["wait", "unratable"])
    return per.select("item", best.alias("b")).select("item", "b.action", F.round("b.p", 6).alias("p"))


@query("select assignment_id, presentation_id, annotator_id from assignment_map")
def prj_15_public_columns(spark, d):
    """The columns that a blinded annotator may see, checked against the exact set."""
    out = table(spark, d, "assignment_map").select("assignment_id", "presentation_id", "annotator_id")
    assert va.differing_fields(out, ["annotator_id", "assignment_id", "presentation_id"]) == ([], [])
    return out


@query(sql("ratings", " select assignment_id, item, annotator, lineage_id, source, stratum, raw_action, confidence, quality, len(tags) as n_tags from ratings"))
def prj_14_validated_rows(spark, d):
    return v.ratings(spark, d).select("assignment_id", "item", "annotator", "lineage_id", "source", "stratum", "raw_action", "confidence", "quality", F.size("tags").alias("n_tags"))


@query(sql("turns", _EPISODES + " select session_id, episode, onset_ms from ep where next_ms is null"))
def stm_03_censored(spark, d):
    """The open episode at the end of each session."""
    e = iv.episodes(iv.merge_touching(v.turns(spark, d), ["session_id", "speaker"]).where("speaker = 'user'"))
    return e.where("right_censored").select("session_id", "episode", "onset_ms")


@query(sql("frames turns", """, f as (select session_id, frame, value from frames where signal_name = 'surprise'),
a as (select distinct session_id, unnest(range(greatest(start_ms // 80, 0), cast(ceil(end_ms / 80.0) as bigint))) as frame from turns where end_ms > 0),
j as (select f.session_id, f.frame, f.value, a.frame is not null as active from f left join a using (session_id, frame)),
k as (select *, frame - row_number() over (partition by session_id, active order by frame) as g from j), r as (select *, count(*) over (partition by session_id, active, g) as n, row_number() over (partition by session_id, active, g order by frame) as i from k),
b as (select value, case when active then 'active' when i <= 3 or n - i < 3 then 'near edge' when n >= 25 then 'long silence' else 'silence' end as bin from r)
select bin, round(avg(value), 6) as mean, count(*) as n from b group by all"""))
def win_14_activity_bins(spark, d):
    """Mean surprise while somebody speaks, near an edge of a silence, in long and in short silences."""
    f = v.frames(spark, d).where("signal_name = 'surprise'").select("session_id", "frame", "value")
    a = iv.interval_frames(v.turns(spark, d), ["session_id"], 80).withColumn("active", F.lit(True))
    j = f.join(a, ["session_id", "frame"], "left").withColumn("active", F.coalesce("active", F.lit(False)))
    w = Window.partitionBy("session_id", "active", "g")  # one run
    r = tl.islands(j, ["session_id", "active"], "g").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("frame")))
    name = F.when(F.col("active"), "active").when((F.col("i") <= 3) | (F.col("n") - F.col("i") < 3), "near edge").when(F.col("n") >= 25, "long silence").otherwise("silence")
    return r.groupBy(name.alias("bin")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(sql("frames", " select session_id, frame as row, value from frames where signal_name = 'surprise'").replace("frame as row", "cast(row_number() over (partition by session_id order by frame) - 1 as bigint) as row"))
def src_11_array_files(spark, d):
    """A .npy file per session written by tasks, read back as rows (SRC-11, SRC-12, SRC-13, SNK-03)."""
    base = place(spark, "arrays")
    series = wr.nested_series(v.frames(spark, d).where("signal_name = 'surprise'"), "value", "values")
    wr.save_arrays(series.select(F.concat(F.lit("dc_"), "session_id").alias("name"), "values"), base)
    return rd.array_files(spark, base, ["values"]).select("session_id", "row", F.col("values")[0].alias("value"))


@query()
def src_21_wav(spark, d):
    """WAV bytes made from series, and the header read back (SRC-21, SNK-08)."""
    import io
    import wave

    series = wr.nested_series(v.frames(spark, d).where("signal_name = 'p_shift'"), "value", "values")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for s, x in zip(pdf["session_id"], pdf["values"], strict=True):
                with wave.open(io.BytesIO(wr.wav_bytes(np.stack([x, x], 1), 8000))) as w:
                    rows.append((s, w.getnchannels(), w.getframerate(), w.getnframes()))
            yield pd.DataFrame(rows, columns=["session_id", "channels", "rate", "frames"])

    return series.mapInPandas(work, "session_id string, channels int, rate int, frames bigint")


@query()
def src_22_synthetic(spark, d):
    """Synthetic sessions: a salient signal ranks events above chance, a random one doesn't."""
    f = sy.salient_frames(spark, 20)
    e = sy.events(spark, 20)
    both = f.select("session_id", "frame", "t_end_ms", "duration_ms", F.explode(F.map_from_arrays(F.array(F.lit("salience"), F.lit("random")), F.array("salience", "random"))).alias("signal_name", "score"))
    return mt.auroc(lb.horizon_labels(both, e, ["turn_shift", "backchannel", "barge_in"], [1000]), ["signal_name", "kind", "horizon_ms"])


def _net(width: int, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    return nu.mlp_init([width, 16, 4], seed)


@query()
def ml_01_forward(spark, d):
    """A ReLU network on every frame."""
    return nu.predicted(v.vectors(spark, d).select("session_id", "frame", "vec"), _net(64), "vec").select("session_id", "frame", "pred")


@query()
def ml_02_attention(spark, d):
    """One attention block over each single frame: with one token the weights are 1, what stays is value and output."""
    rng = np.random.default_rng(9)
    value, out = (rng.normal(0, 1 / 8, (64, 64)) for _ in range(2))

    def work(x: np.ndarray) -> np.ndarray:
        y = x + x @ value @ out
        y = (y - y.mean(1, keepdims=True)) / (y.std(1, keepdims=True) + 1e-6)
        return y @ out[:, :4]

    return nu._mapped(v.vectors(spark, d).select("session_id", "frame", "vec"), work, "vec", "pred").select("session_id", "frame", "pred")


@query()
def ml_03_train(spark, d):
    """Loss over all pairs before and after a short training run on a bounded sample, with and without the energy term."""
    pairs = tl.shifted(v.vectors(spark, d), ["session_id"], "vec", 1).select("session_id", "frame", "vec", "target")
    s = nu.fit_sample(pairs, ["vec", "target"], ["session_id", "frame"])
    x, z = np.stack(s["vec"].to_numpy()), np.stack(s["target"].to_numpy())
    rows = []
    for lam in (0.0, 0.01):
        layers = nu.mlp_init([64, 32, 64], 3)
        first = nu.mlp_loss(pairs, layers, "vec", "target", lam).first()[0]
        nu.mlp_fit(layers, x, z, steps=80, lam=lam)
        rows.append((lam, first, nu.mlp_loss(pairs, layers, "vec", "target", lam).first()[0]))
    return spark.createDataFrame(rows, "lam double, first_loss double, last_loss double")


@query()
def ml_10_ablation(spark, d):
    """Probes on several feature sets: accuracy of each on held-out frames (hash split)."""
    f = v.vectors(spark, d).withColumn("held", F.pmod(F.xxhash64("session_id", "frame"), F.lit(5)) == 0)
    sets = {"first": F.slice("vec", 1, 16), "last": F.slice("vec", 49, 16), "all": F.col("vec")}
    out = None
    for name, x in sets.items():
        g = f.withColumn("x", x)
        s = nu.fit_sample(g.where("not held"), ["x", "label"], ["session_id", "frame"])
        names = sorted(s["label"].unique().tolist())
        model = nu.softmax_fit(np.stack(s["x"].to_numpy()), s["label"].to_numpy(), names, steps=150)
        scored = nu.softmax_scored(g.where("held").select("session_id", "frame", "label", "x"), model, "x")
        at = F.get(F.array(*[F.lit(n) for n in names]), ar.argmax("p").cast("int"))
        row = scored.agg(F.lit(name).alias("features"), F.avg((at == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(sql("ratings", """, o as (select * from ratings where not is_repeat) select source, count(*) as annotations, count(distinct item) as items, count(distinct annotator) as annotators, round(avg(confidence), 6) as confidence, round(avg((raw_action = 'unratable')::int), 6) as unratable from o group by all"""))
def agg_23_bundle(spark, d):
    """Counts and rates of the inter-rater bundle by corpus."""
    o = v.ratings(spark, d).where("not is_repeat")
    return o.groupBy("source").agg(F.count(F.lit(1)).alias("annotations"), F.count_distinct("item").alias("items"), F.count_distinct("annotator").alias("annotators"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg((F.col("raw_action") == "unratable").cast("int")), 6).alias("unratable"))


@query(sql("ratings", _COUNTS + _alpha("source")).replace("select source, items, cast(total as bigint) as ratings, round(1 - d", "select source, true as same, round(1 - d"))
def agg_38_recomputed(spark, d):
    """Alpha by corpus, and whether one pass and the grouping sets give the same number (AGG-38)."""
    o = v.ratings(spark, d).where("not is_repeat")
    a = ag.krippendorff(o, ["source"]).select(F.col("source").alias("name"), F.round("alpha", 9).alias("alpha"))
    b = ag.report(o).where("level = 'corpus'").select("name", F.round("alpha", 9).alias("alpha"))
    wrong = va.mismatches(a, b, ["name"], ["alpha"])
    return a.join(b.select("name"), "name").join(wrong, "name", "left").select(F.col("name").alias("source"), F.col("column").isNull().alias("same"), F.round("alpha", 6).alias("alpha"))


@query()
def compare_report(spark, d):
    """The whole comparison: common frames of every pair of signals, AUROC and AP per session, means and intervals (SNK-01)."""
    return cp.report(v.points(spark, d), v.events(spark, d), replicates=100)


@query()
def compare_rows(spark, d):
    return cp.rows(v.frames(spark, d), v.events(spark, d), v.spans(spark, d), cp.Compare(["surprise"], window_ms=30_000))


@query("select session_id, lower(trim(source)) as source, duration_s, coalesce(duration_s, 0) >= 180 as long_enough from (select distinct session_id, source, duration_s from sessions)")
def str_04_tidy(spark, d):
    s = table(spark, d, "sessions").select("session_id", tidy("source").alias("source"), "duration_s").distinct()
    return s.withColumn("long_enough", F.coalesce("duration_s", F.lit(0.0)) >= 180)


QUERIES = Q

