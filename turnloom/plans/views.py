"""The cleaned tables that the queries share, once as DataFrames and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.columns import event_kind, finite, norm_session, speaker_or_unknown, tidy, to_ms
from turnloom.runtime import table

ELAPSED_BOUNDS, STRATA = [1.0, 3.0], ["<1s", "1-<3s", ">=3s"]

_ID = "regexp_replace(regexp_replace(lower(trim(session_id)), ':(mid|first)(180|300|120|60)?$', ''), '^(candor_|dc_|duplexchat_|duplex_)', '')"
_MS = "case when abs({0}) < 9e12 then try_cast(round({0} * 1000) as bigint) end"
_OK = "case when {0} is not null and not isnan({0}) and not isinf({0}) then {0} end"


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Usable transcript turns: session_id, speaker, start_ms, end_ms, each interval once."""
    t = table(spark, folder, "transcript_turns").select(F.col("session_id"), speaker_or_unknown("speaker").alias("speaker"), to_ms("start_s").alias("start_ms"), to_ms("end_s").alias("end_ms"))
    return t.where("session_id is not null and end_ms > start_ms").distinct()


def events(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "turn_events").select("event_id", norm_session("session_id").alias("session_id"), event_kind("kind").alias("kind"), to_ms("t").alias("t_ms"))
    return t.dropna().distinct()


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Usable points of the series, repeats too."""
    t = table(spark, folder, "chunk_signals").select(norm_session("session_id").alias("session_id"), "signal_name", F.col("frame_idx").cast("bigint").alias("frame"), finite("signal_value").alias("value"))
    return t.dropna()


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Usable points of the series on the nominal 80 ms grid."""
    t = points(spark, folder).groupBy("session_id", "signal_name", "frame").agg(F.max("value").alias("value"))
    return t.withColumn("t_end_ms", (F.col("frame") + 1) * 80)


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Length of each session by its series, from the raw points: repeats don't matter for a maximum."""
    t = table(spark, folder, "chunk_signals").where(F.col("signal_name").isNotNull() & finite("signal_value").isNotNull() & F.col("frame_idx").isNotNull())
    t = t.groupBy(norm_session("session_id").alias("session_id")).agg(((F.max("frame_idx").cast("bigint") + 1) * 80).alias("duration_ms"))
    return t.where("session_id is not null")


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "silence_checkpoints")
    return t.select("checkpoint_id", norm_session("session_id").alias("session_id"), "episode_id", tidy("lineage_id").alias("lineage_id"), tidy("source").alias("source"), "context", "onset_s", "silence_end_s", "model_cutoff_s", finite("elapsed_s").alias("elapsed_s"), "right_censored", "quality").distinct()


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Last answer of each assignment in the map: item, annotator, raw_action, action (null if unratable), the onset, the item's attributes."""
    a = table(spark, folder, "assigned_annotations").select("assignment_id", "submitted_at", tidy("action").alias("raw_action"), F.when(F.col("confidence").between(1, 5), F.col("confidence")).alias("confidence"), "acceptable_onset", "quality", "tags")
    last = a.groupBy("assignment_id").agg(F.max_by(F.struct("raw_action", "confidence", "acceptable_onset", "quality", "tags"), F.struct("submitted_at", "raw_action")).alias("r"))
    m = table(spark, folder, "assignment_map").select("assignment_id", F.col("annotator_id").alias("annotator"), F.col("item_id").alias("item"), "lineage_id", "source", F.col("checkpoint_elapsed_s").alias("elapsed_s"), "is_repeat").distinct()
    stratum = F.when(F.col("elapsed_s") < 1, STRATA[0]).when(F.col("elapsed_s") < 3, STRATA[1]).otherwise(STRATA[2])
    j = m.join(last, "assignment_id")
    return j.select("assignment_id", "item", "annotator", "lineage_id", "source", "elapsed_s", stratum.alias("stratum"), "is_repeat", "r.raw_action", F.when(F.col("r.raw_action") != "unratable", F.col("r.raw_action")).alias("action"), "r.confidence", F.col("r.acceptable_onset.earliest_elapsed_s").alias("earliest"), F.col("r.acceptable_onset.latest_elapsed_s").alias("latest"), F.col("r.acceptable_onset.wait_for_user_resume").alias("waits"), "r.quality", "r.tags")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of vectors: the label plays the session, the order of ids the frame."""
    e = table(spark, folder, "embeddings")
    w = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return e.select(F.col("label").cast("string").alias("session_id"), (w - 1).cast("bigint").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


_SPEAKER = "coalesce(nullif(lower(trim(speaker, E' \\t\\n\\r')), ''), 'unknown')"
_KIND = """case replace(lower(trim(kind)), ' ', '_') when 'turn_shift' then 'turn_shift' when 'turnshift' then 'turn_shift' when 'turn-shift' then 'turn_shift' when 'shift' then 'turn_shift' when 'turn' then 'turn_shift'
  when 'backchannel' then 'backchannel' when 'back_channel' then 'backchannel' when 'back-channel' then 'backchannel' when 'bc' then 'backchannel'
  when 'barge_in' then 'barge_in' when 'bargein' then 'barge_in' when 'barge-in' then 'barge_in' when 'overlap' then 'barge_in' end"""

SQL = {
    "turns": f"""turns as (select distinct * from (select session_id, {_SPEAKER} as speaker, {_MS.format("start_s")} as start_ms, {_MS.format("end_s")} as end_ms from transcript_turns) where session_id is not null and end_ms > start_ms)""",
    "events": f"""events_ as (select distinct * from (select event_id, {_ID} as session_id, {_KIND} as kind, {_MS.format("t")} as t_ms from turn_events) where kind is not null and t_ms is not null)""",
    "frames": f"""frames as (select session_id, signal_name, frame, max(value) as value, (frame + 1) * 80 as t_end_ms from (
      select {_ID} as session_id, signal_name, cast(frame_idx as bigint) as frame, {_OK.format("signal_value")} as value from chunk_signals) where value is not null and frame is not null group by all)""",
    "spans": "spans as (select session_id, max(t_end_ms) as duration_ms from frames group by all)",
    "checkpoints": f"""cp as (select distinct checkpoint_id, {_ID} as session_id, episode_id, lower(trim(lineage_id)) as lineage_id, lower(trim(source)) as source, context, onset_s, silence_end_s, model_cutoff_s, {_OK.format("elapsed_s")} as elapsed_s, right_censored, quality from silence_checkpoints)""",
    "ratings": """answers as (select assignment_id, lower(trim(action)) as raw_action, case when confidence between 1 and 5 then confidence end as confidence, acceptable_onset, quality, tags from assigned_annotations
      qualify row_number() over (partition by assignment_id order by submitted_at desc nulls last, lower(trim(action)) desc) = 1),
    ratings as (select m.assignment_id, item_id as item, annotator_id as annotator, lineage_id, source, checkpoint_elapsed_s as elapsed_s,
      case when checkpoint_elapsed_s < 1 then '<1s' when checkpoint_elapsed_s < 3 then '1-<3s' else '>=3s' end as stratum, is_repeat, raw_action,
      case when raw_action <> 'unratable' then raw_action end as action, confidence, acceptable_onset.earliest_elapsed_s as earliest, acceptable_onset.latest_elapsed_s as latest,
      acceptable_onset.wait_for_user_resume as waits, quality, tags from (select distinct * from assignment_map) m join answers using (assignment_id))""",
    "vectors": "vectors as (select cast(label as varchar) as session_id, cast(row_number() over (partition by label order by vec_id) - 1 as bigint) as frame, cast(embedding as double[]) as vec, label from embeddings)",
}


def sql(views: str, query: str, recursive: bool = False) -> str:
    """``with`` clause of the named views, then the query (which may go on with more of them)."""
    return ("with recursive " if recursive else "with ") + ",\n".join(SQL[v] for v in views.split()) + ("" if query.lstrip().startswith(",") else "\n") + query
