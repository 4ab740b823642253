"""Query and SQL of the interval problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.functions.columns import tidy, to_ms
from turnloom.operators.dyadic import periods_and_gaps
from turnloom.runtime import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps of every speaker in every session of transcript_turns."""
    turns = table(spark, folder, "transcript_turns")
    intervals = turns.select("session_id", tidy("speaker").alias("speaker"), to_ms("start_s").alias("from_ms"), to_ms("end_s").alias("to_ms"))
    return periods_and_gaps(intervals.where("speaker <> ''"), ["session_id", "speaker"])


P2_SQL = """
with given as (
  select session_id, lower(trim(speaker, E' \\t\\n\\r\\f\\v')) as speaker, case when abs(start_s) < 9e12 then try_cast(round(start_s * 1000) as bigint) end as a,
    case when abs(end_s) < 9e12 then try_cast(round(end_s * 1000) as bigint) end as b
  from transcript_turns
  where session_id is not null),
usable as (select * from given where a < b and speaker <> ''),
opened as (select *, coalesce(max(b) over (partition by session_id, speaker order by a, b rows between unbounded preceding and 1 preceding) < a, true) as opens from usable),
numbered as (select *, sum(opens::int) over (partition by session_id, speaker order by a, b rows unbounded preceding) as n from opened),
period as (select session_id, speaker, min(a) as from_ms, max(b) as to_ms from numbered group by session_id, speaker, n),
following as (select session_id, speaker, to_ms as a, lead(from_ms) over (partition by session_id, speaker order by from_ms) as b from period)
select session_id, speaker, 'period' as piece, from_ms, to_ms from period
union all
select session_id, speaker, 'gap', a, b from following where b is not null
"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}
