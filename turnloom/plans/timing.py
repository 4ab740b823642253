"""Queries on series, events and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.columns import EVENT_KINDS, bucket, first_of, half_even, half_up, norm_session, session_from_file, speaker_or_unknown, strip_prefix, strip_window
from turnloom.operators import intervals as iv
from turnloom.operators import labels as lb
from turnloom.operators import metrics as mt
from turnloom.operators import timeline as tl
from turnloom.operators.dyadic import periods_and_gaps
from turnloom.plans import views as v
from turnloom.plans.views import sql
from turnloom.runtime import table

Q: dict = {}
SQL: dict[str, str] = {}
HORIZONS = [500, 1000, 2000]


def query(text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


_KINDS = "(select unnest(['turn_shift', 'backchannel', 'barge_in']) as kind)"


@query("select count(*) as n, count(distinct session_id) as raw, count(distinct " + v._ID + ") as normal from chunk_signals")
def join_02_aliases(spark, d):
    """Raw, suffixed and prefixed forms of an id meet in the normal form."""
    return table(spark, d, "chunk_signals").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("raw"), F.count_distinct(norm_session("session_id")).alias("normal"))


@query(f"select event_id, {v._KIND} as kind, {v._SPEAKER} as speaker from turn_events")
def prj_03_event_kind(spark, d):
    from turnloom.functions.columns import event_kind

    return table(spark, d, "turn_events").select("event_id", event_kind("kind").alias("kind"), speaker_or_unknown("speaker").alias("speaker"))


@query("""select distinct session_id, regexp_replace(session_id, ':(mid|first)(180|300|120|60)?$', '') as without_window,
  regexp_replace(session_id, '^(candor_|dc_|duplexchat_|duplex_)', '', 'i') as without_prefix from turn_events""")
def str_01_session_forms(spark, d):
    return table(spark, d, "turn_events").select("session_id", strip_window("session_id").alias("without_window"), strip_prefix("session_id").alias("without_prefix")).distinct()


@query("""select distinct 'candor_' || session_id || '_turns.csv' as file, session_id as id from sessions""")
def str_03_file_id(spark, d):
    f = table(spark, d, "sessions").select(F.concat(F.lit("candor_"), "session_id", F.lit("_turns.csv")).alias("file")).distinct()
    return f.select("file", session_from_file("file").alias("id"))


@query("select distinct session_id, coalesce(duration_s, 60.0) as seconds, cast(floor(coalesce(duration_s, 60.0) / 0.08 + 0.5) as bigint) as steps, cast(round_even(coalesce(duration_s, 60.0) / 2, 0) as bigint) as half from sessions")
def math_01_rounding(spark, d):
    s = table(spark, d, "sessions").select("session_id", F.coalesce("duration_s", F.lit(60.0)).alias("seconds"))
    return s.select("session_id", "seconds", half_up(F.col("seconds") / 0.08).alias("steps"), half_even(F.col("seconds") / 2).alias("half")).distinct()


@query("select checkpoint_id, case when elapsed_s < 1 then 0 when elapsed_s < 3 then 1 else 2 end as stratum from (select distinct checkpoint_id, elapsed_s from silence_checkpoints where elapsed_s is not null and not isnan(elapsed_s))")
def prj_11_stratum(spark, d):
    c = v.checkpoints(spark, d).where("elapsed_s is not null")
    return c.select("checkpoint_id", bucket("elapsed_s", [1.0, 3.0]).alias("stratum"))


@query("select distinct event_id, coalesce(speaker, kind) as who from turn_events")
def prj_01_first_alias(spark, d):
    t = table(spark, d, "turn_events")
    return t.select("event_id", first_of(t, ["spk", "speaker", "kind"]).alias("who")).distinct()


@query(sql("frames spans", ", g as (select session_id, unnest(range(duration_ms // 80)) as frame from spans) select session_id, frame, frame * 80 as t_start_ms, (frame + 1) * 80 as t_end_ms from g"))
def win_01_grid(spark, d):
    return tl.uniform_grid(v.spans(spark, d)).drop("duration_ms")


@query(sql("frames spans", """, w as (select f.*, cast(round_even((duration_ms - 60000) / 2.0 / 80, 0) as bigint) as s from frames f join spans using (session_id) where duration_ms >= 60000)
select session_id, signal_name, frame - s as frame, value from w where frame - s between 0 and 749"""))
def win_02_mid_crop(spark, d):
    return tl.crop(v.frames(spark, d).join(v.spans(spark, d), "session_id"), 60_000, "mid").select("session_id", "signal_name", "frame", "value")


@query(sql("frames spans", "select session_id, duration_ms from spans where duration_ms < 60000"))
def flt_07_too_short(spark, d):
    return tl.too_short(v.spans(spark, d), 60_000)


@query(sql("frames", "select session_id, signal_name, frame // 4 as frame, round(avg(value), 6) as value from frames group by all having count(*) = 4"))
def agg_13_pool(spark, d):
    return tl.pool(v.frames(spark, d), ["session_id", "signal_name"]).select("session_id", "signal_name", "frame", F.round("value", 6).alias("value"))


@query(sql("frames spans", "select session_id, signal_name, count(*) as n, abs(count(*) - duration_ms / 1000.0 * 50) < abs(count(*) - duration_ms / 1000.0 * 12.5) as pools from frames join spans using (session_id) group by session_id, signal_name, duration_ms"))
def agg_14_needs_pooling(spark, d):
    n = v.frames(spark, d).groupBy("session_id", "signal_name").agg(F.count(F.lit(1)).alias("n")).join(v.spans(spark, d), "session_id")
    return n.select("session_id", "signal_name", "n", tl.needs_pooling(F.col("n"), F.col("duration_ms")).alias("pools"))


@query(sql("frames", "select session_id, frame, a.value as surprise, b.value as audio_nll from frames a join frames b using (session_id, frame) where a.signal_name = 'surprise' and b.signal_name = 'audio_nll'"))
def join_04_align(spark, d):
    return tl.wide(v.frames(spark, d), ["surprise", "audio_nll"], ["session_id"])


@query(sql("frames", "select a.session_id, a.signal_name, a.frame, a.value, b.value as target from frames a join frames b on a.session_id = b.session_id and a.signal_name = b.signal_name and b.frame = a.frame + 12"))
def join_09_shift(spark, d):
    return tl.shifted(v.frames(spark, d).drop("t_end_ms"), ["session_id", "signal_name"], "value", 12)


@query(sql("frames", """, m as (select session_id, signal_name, frame, value > 0.8 as high from frames),
i as (select *, frame - row_number() over (partition by session_id, signal_name, high order by frame) as k from m)
select session_id, signal_name, high, min(frame) as frame, count(*) as n_frames from i group by session_id, signal_name, high, k having count(*) >= 5"""))
def win_06_runs(spark, d):
    m = v.frames(spark, d).withColumn("high", F.col("value") > 0.8)
    return tl.runs(m, ["session_id", "signal_name"], "high").where("n_frames >= 5")


@query(sql("turns", """, f as (select session_id, speaker, unnest(range(greatest(start_ms // 80, 0), cast(ceil(end_ms / 80.0) as bigint))) as frame from turns where end_ms > 0) select distinct * from f"""))
def win_09_mask(spark, d):
    return iv.interval_frames(v.turns(spark, d), ["session_id", "speaker"], 80)


def _bad(t: str) -> str:
    return f"""o as (select *, lag(end_ms) over (partition by session_id, speaker order by start_ms, end_ms) as p from {t}),
bad as (select distinct session_id, speaker from o where start_ms < p)"""


_MERGED = f""", {_bad("turns")}, good as (select * from o anti join bad using (session_id, speaker)),
isl as (select *, sum(coalesce((start_ms <> p)::int, 1)) over (partition by session_id, speaker order by start_ms, end_ms) as k from good),
merged as (select session_id, speaker, min(start_ms) as start_ms, max(end_ms) as end_ms from isl group by session_id, speaker, k)"""


@query(sql("turns", _MERGED + " select * from merged"))
def win_03_merge_touching(spark, d):
    return iv.merge_touching(v.turns(spark, d), ["session_id", "speaker"]).select("session_id", "speaker", "start_ms", "end_ms")


@query(sql("turns", f", {_bad('turns')} select session_id, speaker, count(*) as n_overlaps from o where start_ms < p group by all"))
def val_05_overlaps(spark, d):
    return iv.overlapping_keys(v.turns(spark, d), ["session_id", "speaker"])


_EPISODES = _MERGED + """, ep as (select session_id, row_number() over w - 1 as episode, end_ms as onset_ms, lead(start_ms) over w as next_ms from merged where speaker = 'user' window w as (partition by session_id order by start_ms))"""


@query(sql("turns", _EPISODES + " select *, next_ms is null as right_censored from ep"))
def win_04_episodes(spark, d):
    return iv.episodes(iv.merge_touching(v.turns(spark, d), ["session_id", "speaker"]).where("speaker = 'user'"))


@query(sql("turns", _EPISODES + """, len as (select session_id, max(end_ms) + 5000 as duration_ms from turns group by all),
pts as (select session_id, episode, onset_ms, next_ms is null as right_censored, coalesce(next_ms, duration_ms) as until_ms, unnest([240, 480, 960, 2000, 3000]) as elapsed_ms from ep join len using (session_id)),
cps as (select *, onset_ms + elapsed_ms as cutoff_ms from pts where onset_ms + elapsed_ms < until_ms)
select c.session_id, episode, elapsed_ms, cutoff_ms, right_censored, coalesce(bool_or(t.start_ms is not null), false) as assistant_active
from cps c left join turns t on t.session_id = c.session_id and t.speaker = 'assistant' and t.start_ms <= cutoff_ms and cutoff_ms < t.end_ms group by all"""))
def win_05_checkpoints(spark, d):
    """Checkpoints on the elapsed grid with what the assistant does there."""
    t = v.turns(spark, d)
    return _checkpoints(t, iv.merge_touching(t, ["session_id", "speaker"]))


def _checkpoints(t: DataFrame, merged: DataFrame) -> DataFrame:
    eps = iv.episodes(merged.where("speaker = 'user'"))
    length = t.groupBy("session_id").agg((F.max("end_ms") + 5000).alias("duration_ms"))
    points = iv.checkpoints(eps, length, [240, 480, 960, 2000, 3000])
    out = iv.stab(points, t.where("speaker = 'assistant'"), "session_id", "cutoff_ms", "assistant_active")
    return out.select("session_id", "episode", F.col("elapsed_ms").cast("int").alias("elapsed_ms"), "cutoff_ms", "right_censored", "assistant_active")


_PERIODS = """, opened as (select *, coalesce(max(end_ms) over (partition by session_id, speaker order by start_ms, end_ms rows between unbounded preceding and 1 preceding) < start_ms, true) as opens from turns),
numbered as (select *, sum(opens::int) over (partition by session_id, speaker order by start_ms, end_ms rows unbounded preceding) as k from opened),
merged as (select session_id, speaker, min(start_ms) as start_ms, max(end_ms) as end_ms from numbered group by session_id, speaker, k)"""


def _periods(t: DataFrame) -> DataFrame:
    """Continuous periods of each speaker, overlaps merged: no session is lost."""
    p = periods_and_gaps(t, ["session_id", "speaker"], "start_ms", "end_ms").where("piece = 'period'")
    return p.select("session_id", "speaker", F.col("from_ms").alias("start_ms"), F.col("to_ms").alias("end_ms"))


def _on_periods(name: str) -> str:
    """SQL of a query on strictly merged intervals, on continuous periods instead."""
    return SQL[name].replace(_MERGED, _PERIODS)


@query(_on_periods("win_03_merge_touching"))
def win_03_periods(spark, d):
    """WIN-03 for all sessions: overlapping intervals are merged instead of rejected."""
    return _periods(v.turns(spark, d))


@query(_on_periods("win_04_episodes"))
def win_04_period_episodes(spark, d):
    return iv.episodes(_periods(v.turns(spark, d)).where("speaker = 'user'"))


@query(_on_periods("win_05_checkpoints"))
def win_05_period_checkpoints(spark, d):
    """Checkpoints of all sessions."""
    t = v.turns(spark, d)
    return _checkpoints(t, _periods(t))


@query(_on_periods("win_04_episodes").replace("select *, next_ms is null as right_censored from ep", "select session_id, episode, onset_ms from ep where next_ms is null"))
def stm_03_period_censored(spark, d):
    """The open episode at the end of every session in which the user speaks."""
    return iv.episodes(_periods(v.turns(spark, d)).where("speaker = 'user'")).where("right_censored").select("session_id", "episode", "onset_ms")


@query(sql("turns events", """, e as (select distinct session_id, t_ms from events_)
select e.session_id, e.t_ms, coalesce(bool_or(t.start_ms is not null), false) as speaking from e left join turns t on t.session_id = e.session_id and t.start_ms <= e.t_ms and e.t_ms < t.end_ms group by all"""))
def join_10_stab(spark, d):
    e = v.events(spark, d).select("session_id", "t_ms").distinct()
    return iv.stab(e, v.turns(spark, d), "session_id", "t_ms", "speaking")


@query(sql("turns", """, j as (
  select a.session_id, a.speaker, a.start_ms, a.end_ms, coalesce(bool_or(b.speaker <> a.speaker and b.start_ms <= a.start_ms and a.start_ms < b.end_ms), false) as covering,
    coalesce(bool_or(b.speaker <> a.speaker and b.end_ms <= a.start_ms and a.start_ms - b.end_ms <= 250), false) as recent
  from turns a left join turns b on a.session_id = b.session_id group by all),
f as (select a.session_id, a.speaker, a.start_ms, a.end_ms, b.speaker as holder from turns a join turns b on a.session_id = b.session_id and b.start_ms < a.start_ms
  qualify row_number() over (partition by a.session_id, a.speaker, a.start_ms, a.end_ms order by b.end_ms desc, b.start_ms desc, b.speaker) = 1)
select j.session_id, j.speaker, j.start_ms, j.end_ms, case when covering and j.end_ms - j.start_ms <= 600 then 'backchannel' when covering then 'barge_in' when recent and j.end_ms - j.start_ms <= 600 then 'backchannel'
  when holder <> j.speaker then 'turn_shift' end as kind from j left join f using (session_id, speaker, start_ms, end_ms)"""))
def join_07_classify(spark, d):
    """Proxy events from overlaps, recency and the floor (JOIN-07 and JOIN-08)."""
    return iv.classify_starts(v.turns(spark, d))


_NEXT = """, n as (select f.session_id, f.signal_name, f.frame, f.value, f.t_end_ms, k.kind, min(e.t_ms) as next_ms
  from frames f cross join """ + _KINDS + """ k left join events_ e on e.session_id = f.session_id and e.kind = k.kind and e.t_ms > f.t_end_ms and e.t_ms <= f.t_end_ms + 2000
  where f.signal_name = 'surprise' group by all),
lab as (select n.*, h as horizon_ms, coalesce(next_ms <= t_end_ms + h, false)::int as y from n join spans using (session_id), (select unnest([500, 1000, 2000]::bigint[]) as h) where t_end_ms + h <= duration_ms)"""


_YS = [f"y{i}" for i in range(len(EVENT_KINDS) * len(HORIZONS))]


def _flagged(spark: SparkSession, d: str, which: str = "signal_name = 'surprise'") -> DataFrame:
    """Frames with a label column per kind and horizon, ``score`` beside."""
    f = v.frames(spark, d).where(which).withColumn("score", F.col("value"))
    return lb.horizon_flags(f, v.events(spark, d), EVENT_KINDS, HORIZONS, v.spans(spark, d))


def _named(df: DataFrame) -> DataFrame:
    return lb.named_flags(df, EVENT_KINDS, HORIZONS)


@query(sql("frames spans events", _NEXT + " select session_id, kind, horizon_ms, count(*) as n_chunks, cast(sum(y) as bigint) as n_pos, cast(sum(1 - y) as bigint) as n_neg from lab group by all"))
def join_05_horizon_labels(spark, d):
    """Half-open range labels, counted per session, kind and horizon (JOIN-05, AGG-07, JOIN-15)."""
    return _named(mt.counts_each(_flagged(spark, d), ["session_id"], _YS)).select("session_id", "kind", "horizon_ms", "n_chunks", "n_pos", "n_neg")


@query(sql("frames events", """, n as (select f.session_id, f.frame, f.t_end_ms, min(e.t_ms) as next_ms from frames f left join (select distinct session_id, t_ms from events_) e on e.session_id = f.session_id and e.t_ms > f.t_end_ms and e.t_ms <= f.t_end_ms + 2000 where signal_name = 'surprise' group by all)
select session_id, frame, round(case when next_ms is null then 0.0 else exp(-(next_ms - t_end_ms) / 600.0) end, 6) as salience from n"""))
def join_06_next_event(spark, d):
    e = v.events(spark, d).select("session_id", "t_ms").distinct()
    out = lb.salience(v.frames(spark, d).where("signal_name = 'surprise'"), e, ["session_id"])
    return out.select("session_id", "frame", F.round("salience", 6).alias("salience"))


@query(sql("events turns", """, src as (select session_id, kind as what, 0 as priority from events_ union all select session_id, speaker, 1 from turns union all select lineage_id, source, 2 from sessions)
select session_id, what, priority, count(*) as n from src where priority = (select min(priority) from src s where s.session_id = src.session_id) group by all"""))
def join_03_precedence(spark, d):
    a = v.events(spark, d).select("session_id", F.col("kind").alias("what"))
    b = v.turns(spark, d).select("session_id", F.col("speaker").alias("what"))
    c = table(spark, d, "sessions").select(F.col("lineage_id").alias("session_id"), F.col("source").alias("what"))
    return lb.by_precedence([a, b, c]).groupBy("session_id", "what", "priority").agg(F.count(F.lit(1)).alias("n"))


_AUROC = """, s as (select kind, horizon_ms, value, sum(y) as pos, sum(1 - y) as neg from lab group by all),
c as (select *, sum(pos) over (partition by kind, horizon_ms order by value desc) as tp, sum(neg) over (partition by kind, horizon_ms order by value desc) as fp from s)"""


@query(sql("frames spans events", _NEXT + _AUROC + """ select kind, horizon_ms, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg, round(case when sum(pos) > 0 and sum(neg) > 0 then sum(neg * (tp - pos + pos / 2.0)) / (sum(pos) * sum(neg)) end, 6) as auroc from c group by all"""))
def agg_01_auroc(spark, d):
    """AUROC of surprise over all sessions, by kind and horizon."""
    return _named(mt.auroc_each(_flagged(spark, d), [], _YS)).select("kind", "horizon_ms", "n_pos", "n_neg", F.round("auroc", 6).alias("auroc"))


_RANKED = """, r as (select *, row_number() over w as rn, sum(y) over (w rows unbounded preceding) as hits from lab window w as (partition by kind, horizon_ms order by value desc, session_id, frame))"""


@query(sql("frames spans events", _NEXT + _RANKED + """ select kind, horizon_ms, round(case when sum(y) > 0 and sum(y) < count(*) then avg(case when y = 1 then hits / rn::double end) end, 6) as ap from r group by all"""))
def agg_02_average_precision(spark, d):
    return _named(mt.average_precision_each(_flagged(spark, d), [], ["session_id", "frame"], _YS)).select("kind", "horizon_ms", F.round("ap", 6).alias("ap"))


@query(sql("frames spans events", _NEXT + """, t as (select kind, horizon_ms, count(*) filter (value >= 1.0 and y = 1) as tp, count(*) filter (value >= 1.0 and y = 0) as fp, count(*) filter (value < 1.0 and y = 1) as fn from lab group by all),
q as (select *, tp / nullif(tp + fp, 0)::double as p, tp / nullif(tp + fn, 0)::double as r from t)
select kind, horizon_ms, tp, fp, fn, round(p, 6) as "precision", round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f1 from q"""))
def agg_03_threshold(spark, d):
    out = _named(mt.at_threshold_each(_flagged(spark, d), [], 1.0, _YS))
    return out.select("kind", "horizon_ms", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(sql("frames spans events", _NEXT + _AUROC + """, t as (select kind, horizon_ms, sum(pos) as p, sum(neg) as n from c group by all)
select kind, horizon_ms, value as threshold, round(2.0 * tp / (tp + fp + p), 6) as f1 from c join t using (kind, horizon_ms) where p > 0 and n > 0
qualify row_number() over (partition by kind, horizon_ms order by 2.0 * tp / (tp + fp + p) desc, value desc) = 1"""))
def agg_04_best_f1(spark, d):
    return _named(mt.best_f1_each(_flagged(spark, d), [], _YS)).select("kind", "horizon_ms", "threshold", F.round("f1", 6).alias("f1"))


@query(sql("frames spans events", _NEXT + _RANKED + """, t as (select kind, horizon_ms, sum(y) as p from lab group by all)
select kind, horizon_ms, round(max(case when p > 0 and hits >= 0.5 * p then hits / rn::double end), 6) as precision_at_recall from r join t using (kind, horizon_ms) group by all"""))
def agg_05_precision_at_recall(spark, d):
    return _named(mt.precision_at_recall_each(_flagged(spark, d), [], ["session_id", "frame"], 0.5, _YS)).select("kind", "horizon_ms", F.round("precision_at_recall", 6).alias("precision_at_recall"))


_PER_SESSION = """, s as (select session_id, kind, horizon_ms, value, sum(y) as pos, sum(1 - y) as neg from lab group by all),
c as (select *, sum(pos) over (partition by session_id, kind, horizon_ms order by value desc) as tp from s),
a as (select session_id, kind, horizon_ms, case when sum(pos) > 0 and sum(neg) > 0 then sum(neg * (tp - pos + pos / 2.0)) / (sum(pos) * sum(neg)) end as auroc from c group by all)"""


@query(sql("frames spans events", _NEXT + _PER_SESSION + " select kind, horizon_ms, round(avg(auroc), 6) as mean_auroc, count(auroc) as n_sessions from a group by all"))
def agg_08_mean_over_sessions(spark, d):
    a = _named(mt.auroc_each(_flagged(spark, d), ["session_id"], _YS))
    return a.groupBy("kind", "horizon_ms").agg(F.round(F.avg("auroc"), 6).alias("mean_auroc"), F.count("auroc").alias("n_sessions"))


def _by_signal(name: str) -> str:
    """SQL of a query on surprise, for every signal by itself."""
    return SQL[name].replace("where f.signal_name = 'surprise' ", "").replace("kind, horizon_ms", "signal_name, kind, horizon_ms")


_SIGNAL = ["signal_name", "kind", "horizon_ms"]


@query(_by_signal("join_05_horizon_labels"))
def join_05_labels_by_signal(spark, d):
    """Labels of every signal's frames, counted per session, signal, kind and horizon."""
    return _named(mt.counts_each(_flagged(spark, d, "true"), ["session_id", "signal_name"], _YS)).select("session_id", *_SIGNAL, "n_chunks", "n_pos", "n_neg")


@query(sql("frames events", """, n as (select f.session_id, f.signal_name, f.frame, f.t_end_ms, min(e.t_ms) as next_ms from frames f left join (select distinct session_id, t_ms from events_) e on e.session_id = f.session_id and e.t_ms > f.t_end_ms and e.t_ms <= f.t_end_ms + 2000 group by all)
select session_id, signal_name, frame, round(case when next_ms is null then 0.0 else exp(-(next_ms - t_end_ms) / 600.0) end, 6) as salience from n"""))
def join_06_next_event_by_signal(spark, d):
    e = v.events(spark, d).select("session_id", "t_ms").distinct()
    return lb.salience(v.frames(spark, d), e, ["session_id"]).select("session_id", "signal_name", "frame", F.round("salience", 6).alias("salience"))


@query(_by_signal("agg_01_auroc"))
def agg_01_auroc_by_signal(spark, d):
    """AUROC of every signal over all sessions that have it, by kind and horizon."""
    return _named(mt.auroc_each(_flagged(spark, d, "true"), ["signal_name"], _YS)).select(*_SIGNAL, "n_pos", "n_neg", F.round("auroc", 6).alias("auroc"))


@query(_by_signal("agg_02_average_precision"))
def agg_02_average_precision_by_signal(spark, d):
    return _named(mt.average_precision_each(_flagged(spark, d, "true"), ["signal_name"], ["session_id", "frame"], _YS)).select(*_SIGNAL, F.round("ap", 6).alias("ap"))


@query(_by_signal("agg_03_threshold"))
def agg_03_threshold_by_signal(spark, d):
    out = _named(mt.at_threshold_each(_flagged(spark, d, "true"), ["signal_name"], 1.0, _YS))
    return out.select(*_SIGNAL, "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_by_signal("agg_04_best_f1"))
def agg_04_best_f1_by_signal(spark, d):
    best = _named(mt.best_f1_each(_flagged(spark, d, "true"), ["signal_name"], _YS))
    return best.select(*_SIGNAL, "threshold", F.round("f1", 6).alias("f1"))


@query(_by_signal("agg_05_precision_at_recall"))
def agg_05_precision_at_recall_by_signal(spark, d):
    out = _named(mt.precision_at_recall_each(_flagged(spark, d, "true"), ["signal_name"], ["session_id", "frame"], 0.5, _YS))
    return out.select(*_SIGNAL, F.round("precision_at_recall", 6).alias("precision_at_recall"))


@query(_by_signal("agg_08_mean_over_sessions"))
def agg_08_mean_over_sessions_by_signal(spark, d):
    a = _named(mt.auroc_each(_flagged(spark, d, "true"), ["session_id", "signal_name"], _YS))
    return a.groupBy(*_SIGNAL).agg(F.round(F.avg("auroc"), 6).alias("mean_auroc"), F.count("auroc").alias("n_sessions"))


@query(sql("turns", """, f as (select distinct session_id, speaker, unnest(range(greatest(start_ms // 80, 0), cast(ceil(end_ms / 80.0) as bigint))) as frame from turns where end_ms > 0),
g as (select session_id, unnest(range(max(frame) + 1)) as frame from f group by session_id),
m as (select g.session_id, g.frame, bool_or(coalesce(speaker = 'user', false)) as u, bool_or(coalesce(speaker = 'assistant', false)) as a from g left join f using (session_id, frame) group by all)
select session_id, round(avg(a::int), 6) as speak, round(avg((a and u)::int), 6) as overlap, round(avg((a and not u)::int), 6) as gap, round(avg((not a and not u)::int), 6) as mutual_silence, count(*) as n_frames from m group by all"""))
def agg_30_masses(spark, d):
    out = mt.masses(_masks(spark, d), ["session_id"])
    return out.select("session_id", *[F.round(c, 6).alias(c) for c in ("speak", "overlap", "gap", "mutual_silence")], "n_frames")


def _masks(spark: SparkSession, d: str) -> DataFrame:
    f = iv.interval_frames(v.turns(spark, d), ["session_id", "speaker"], 80)
    grid = f.groupBy("session_id").agg(F.max("frame").alias("_m")).select("session_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "_m")).alias("frame"))
    on = f.groupBy("session_id", "frame").agg(F.max(F.col("speaker") == "user").alias("user"), F.max(F.col("speaker") == "assistant").alias("assistant"))
    j = grid.join(on, ["session_id", "frame"], "left")
    return j.select("session_id", "frame", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("user", "assistant")])


@query(sql("frames", """, m as (select session_id, signal_name, median(value) as med, quantile_cont(value, 0.8) as p80 from frames group by all),
x as (select session_id, signal_name, median(abs(value - med)) as mad from frames join m using (session_id, signal_name) group by all)
select session_id, signal_name, round(case when mad < 1e-12 then greatest(p80, med + 1e-12) else med + 3 * mad end, 6) as threshold from m join x using (session_id, signal_name)"""))
def agg_29_robust_threshold(spark, d):
    t = mt.robust_threshold(v.frames(spark, d), ["session_id", "signal_name"])
    return t.select("session_id", "signal_name", F.round("threshold", 6).alias("threshold"))


@query(sql("frames", """, m as (select session_id, signal_name, frame, value, value <= 0.8 as low from frames), i as (select *, frame - row_number() over (partition by session_id, signal_name, low order by frame) as k from m),
r as (select session_id, signal_name, count(*) as n, avg(value) as mean, var_pop(value) as var from i where low group by session_id, signal_name, k having count(*) >= 25)
select session_id, count(*) as n_long_runs, round(avg(var), 6) as long_var_mean, bool_or(var < 1e-8 or (mean < 1e-4 and sqrt(var) < 1e-6)) as collapsed from r group by all"""))
def agg_32_silence_runs(spark, d):
    """Runs of at least 2 s below a level: variance and collapse."""
    m = v.frames(spark, d).where("value <= 0.8")
    r = tl.islands(m, ["session_id", "signal_name"], "k").groupBy("session_id", "signal_name", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")).where("n >= 25")
    out = mt.silence_runs(r, ["session_id"])
    return out.select("session_id", "n_long_runs", F.round("long_var_mean", 6).alias("long_var_mean"), "collapsed")


@query(sql("frames", """, w as (select session_id, signal_name, value, unnest(range(cast(greatest(0, ceil((frame - 24) / 10.0)) as bigint), frame // 10 + 1)) as place from frames)
select session_id, signal_name, place, round(sqrt(avg(value * value)), 6) as rms from w group by all having count(*) = 25"""))
def win_07_sliding_rms(spark, d):
    """Windows of 25 frames every 10; only whole ones."""
    out = tl.sliding_frames(v.frames(spark, d), ["session_id", "signal_name"], 25, 10, {"rms": F.sqrt(F.avg(F.col("value") * F.col("value")))})
    return out.select("session_id", "signal_name", "place", F.round("rms", 6).alias("rms"))


_ENDS = ", e as (select session_id, signal_name, max(frame) as last from frames group by all)"


@query(sql("frames", _ENDS + """, p as (select *, unnest(range(10)) as i from e), q as (select session_id, signal_name, i, cast(trunc(i * (last / 9.0::double)) as bigint) as frame from p)
select session_id, signal_name, i, f.value from q left join frames f using (session_id, signal_name, frame)"""))
def win_10_resample(spark, d):
    """Ten evenly spread frames of each series, places truncated."""
    return tl.resampled_nearest(v.frames(spark, d), ["session_id", "signal_name"], 10)


@query(sql("frames", _ENDS + """, p as (select *, unnest(range(16)) as i from e), q as (select session_id, signal_name, i, i * last / 15.0::double as x from p)
select q.session_id, q.signal_name, i, round(a.value + (b.value - a.value) * (x - floor(x)), 4) as value from q
left join frames a on a.session_id = q.session_id and a.signal_name = q.signal_name and a.frame = floor(x) left join frames b on b.session_id = q.session_id and b.signal_name = q.signal_name and b.frame = ceil(x)"""))
def win_11_linear_resample(spark, d):
    out = tl.resampled_linear(v.frames(spark, d), ["session_id", "signal_name"], 16)
    return out.select("session_id", "signal_name", "i", F.round("value", 4).alias("value"))


@query(sql("frames", "select a.session_id, a.signal_name, a.frame, b.value from frames a left join frames b on a.session_id = b.session_id and a.signal_name = b.signal_name and b.frame = a.frame + 3"))
def win_12_undelay(spark, d):
    return tl.undelay(v.frames(spark, d).drop("t_end_ms"), ["session_id", "signal_name"], F.lit(3))


@query(sql("events", "select event_id, session_id, kind, t_ms - 10000 as t_ms from events_ where t_ms >= 10000 and t_ms < 70000"))
def prj_08_rebase(spark, d):
    """Events of a minute, with times from its start (FLT-03)."""
    return lb.rebased(v.events(spark, d), F.lit(10_000), 60_000)


@query(sql("frames", "select session_id, signal_name, count(*) as n from frames group by all having count(*) >= 2"))
def flt_04_series_only(spark, d):
    return v.frames(spark, d).groupBy("session_id", "signal_name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query(sql("frames", "select session_id, frame from frames where signal_name = 'surprise' intersect select session_id, frame from frames where signal_name = 'p_shift'"))
def set_01_common_frames(spark, d):
    f = v.frames(spark, d)
    return f.where("signal_name = 'surprise'").select("session_id", "frame").intersect(f.where("signal_name = 'p_shift'").select("session_id", "frame"))


@query(f"select distinct {v._ID} as session_id from turn_events union select distinct {v._ID} from chunk_signals union select distinct {v._ID} from sessions")
def set_03_all_sessions(spark, d):
    ids = [table(spark, d, t).select(norm_session("session_id").alias("session_id")) for t in ("turn_events", "chunk_signals", "sessions")]
    return ids[0].unionByName(ids[1]).unionByName(ids[2]).distinct()


@query(sql("frames", """select session_id, frame, case when frame % 2 = 0 then 1 - value else value end as p_shift, exp(least(value, 20)) as perplexity from frames where signal_name = 'p_shift'""").replace("as p_shift, exp(least(value, 20)) as perplexity", "as p, round(exp(value), 6) as perplexity"))
def prj_06_shift_probability(spark, d):
    """Probability of a shift from that of the present speaker, by speaker (PRJ-06), and exp of a likelihood (AGG-11)."""
    f = v.frames(spark, d).where("signal_name = 'p_shift'")
    return f.select("session_id", "frame", F.when(F.col("frame") % 2 == 0, 1 - F.col("value")).otherwise(F.col("value")).alias("p"), F.round(F.exp("value"), 6).alias("perplexity"))


QUERIES = Q
