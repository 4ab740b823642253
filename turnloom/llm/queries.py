"""Queries of the training-data problems, and SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.columns import finite, known, norm_session
from turnloom.llm.consensus import alpha, calibration, last_details, last_ratable_answers, reweighted_votes
from turnloom.llm.cube import balanced_sample, margins, stratum
from turnloom.llm.lookalike import consistent_text, lookalike_classes, lookalike_members, lookalike_pairs
from turnloom.llm.mixing import mix_by_temperature, mix_to_targets
from turnloom.llm.nearest import nearest_in_time
from turnloom.llm.packing import pack
from turnloom.llm.splits import components, grouped_splits
from turnloom.llm.tokens import count_tokens
from turnloom.llm.turns import ASSISTANT_LABELS, HESITATION, USER_LABELS, sessions_without_role, speaker_turns
from turnloom.runtime import spill, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


# 1. consensus


def _consensus(spark: SparkSession, folder: str):
    return reweighted_votes(last_ratable_answers(table(spark, folder, "assigned_annotations"), table(spark, folder, "assignment_map")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    items = _consensus(spark, folder)[0]
    return items.where("n_annotators >= 3").select(F.col("item").alias("item_id"), F.col("answer").alias("action"))


def p1_annotators(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder)[1].select(F.col("annotator").alias("annotator_id"), "n_votes", "n_scored", "accuracy", "weight")


def p1_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """What confidence and alternates say about each annotator, against the consensus."""
    a, m = table(spark, folder, "assigned_annotations"), table(spark, folder, "assignment_map")
    consensus, _, votes = reweighted_votes(last_ratable_answers(a, m))
    return calibration(consensus, votes, last_details(a, m)).withColumnRenamed("annotator", "annotator_id")


def p1_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Alpha over all originals."""
    return alpha(last_ratable_answers(table(spark, folder, "assigned_annotations"), table(spark, folder, "assignment_map")))


# 3. nearest in time


def _events_and_chunks(spark: SparkSession, folder: str):
    events = table(spark, folder, "turn_events").select(norm_session("session_id").alias("entity"), F.col("event_id").alias("id"), "t")
    chunks = table(spark, folder, "chunk_signals").select(norm_session("session_id").alias("entity"), F.col("signal_name").alias("series"), F.col("chunk_id").alias("id"), F.col("t_end").alias("t"))
    return events, chunks


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    events, chunks = _events_and_chunks(spark, folder)
    return nearest_in_time(events, chunks, 0.12).select(F.col("left_id").alias("event_id"), F.col("right_id").alias("chunk_id"))


# 4. sample with target shares


def _sample(spark: SparkSession, folder: str):
    rows = table(spark, folder, "silence_checkpoints").select("checkpoint_id", known("source").alias("source"), known("lineage_id").alias("lineage_id"), finite("elapsed_s").alias("elapsed_s")).where("elapsed_s >= 0")
    rows = rows.withColumn("elapsed_stratum", stratum("elapsed_s"))
    return balanced_sample(rows, table(spark, folder, "sample_targets"), ["source", "elapsed_stratum"], "checkpoint_id", "lineage_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of which the cube sample holds fewer rows than wanted."""
    return _sample(spark, folder)[1].where("taken < wanted").select("source", "elapsed_stratum")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder)[1]


def p4_margins(spark: SparkSession, folder: str) -> DataFrame:
    """The sample by source alone and by stratum alone."""
    return margins(_sample(spark, folder)[1], ["source", "elapsed_stratum"])


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder)[0]


# 5. speaker turns


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The whole reconstruction, texts included; its texts are in p5_turns."""
    return speaker_turns(table(spark, folder, "raw_turns")).select("session_id", "turn_speaker", "opening_line_id", "n_lines")


def p5_turns(spark: SparkSession, folder: str) -> DataFrame:
    return speaker_turns(table(spark, folder, "raw_turns"))


def p5_without_role(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that p5_found leaves out: not one line names a role."""
    return sessions_without_role(table(spark, folder, "raw_turns"))


# 6. splits


def _related(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "silence_checkpoints").select("checkpoint_id", known("lineage_id").alias("lineage"), norm_session("session_id").alias("session"))


LINEAGE = "lineage:"


def _components(spark: SparkSession, folder: str) -> DataFrame:
    """(label, lineage): lineages with one label are joined by sessions."""
    known_ = _related(spark, folder).where("lineage is not null")
    own = F.concat(F.lit(LINEAGE), "lineage")
    edges = known_.select(own.alias("a"), F.coalesce(F.concat(F.lit("session:"), "session"), own).alias("b")).distinct()
    labels = components(edges)
    return spill(labels.where(F.col("vertex").startswith(LINEAGE)).select("label", F.expr(f"substring(vertex, {len(LINEAGE) + 1})").alias("lineage")), "lineages")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of lineages in one component: the pairs are what the problem asks for; p6_members has a row per lineage."""
    lineages = _components(spark, folder)
    joined = lineages.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label")
    mates = lineages.join(joined, "label", "left_semi")
    a, b = mates.select("label", F.col("lineage").alias("lineage_a")), mates.select("label", F.col("lineage").alias("lineage_b"))
    return a.join(b, "label").where("lineage_a < lineage_b").select("lineage_a", "lineage_b")


def p6_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every lineage with the first lineage of its component, and how many it has."""
    lineages = _components(spark, folder)
    first = lineages.groupBy("label").agg(F.min("lineage").alias("representative"), F.count(F.lit(1)).alias("n_lineages"))
    return lineages.join(first, "label").select("lineage", "representative", "n_lineages")


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Split of every record."""
    return grouped_splits(_related(spark, folder), ["lineage", "session"], SHARES)[0]


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_splits(_related(spark, folder), ["lineage", "session"], SHARES)[2]


# 7. containers


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the packing cut into several pieces."""
    pieces = pack(_sizes(spark, folder))
    return pieces.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("item").alias("doc_id"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_sizes(spark, folder)).select(F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container")


def _bytes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_tokens"))


def p7_split_by_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """The packing with sizes in bytes instead of tokens, which SQL can follow: the pieces of each document that is split."""
    pieces = pack(_bytes(spark, folder).select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size")))
    g = pieces.where("container is not null").groupBy(F.col("item").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("size").alias("n_bytes"), F.count_distinct("container").alias("n_containers"))
    return g.where("n_pieces > 1")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(_sizes(spark, folder)).where("container is not null")
    return pieces.agg(F.count_distinct("container").alias("n_containers"), F.sum("size").alias("n_tokens")).withColumn("fill", F.try_divide("n_tokens", F.col("n_containers") * 2048.0))


# 8. mixtures


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents").select("doc_id", "source", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mix_to_targets(_sources(spark, folder), table(spark, folder, "mix_targets"))[1].where("falls_short").select("source")


def p8_short_by_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture with sizes in bytes instead of tokens, which SQL can follow: bytes, whether a source falls short, how much of it is used if so (else 0)."""
    report = mix_to_targets(_bytes(spark, folder), table(spark, folder, "mix_targets"))[1]
    return report.select("source", F.col("tokens").alias("n_bytes"), "falls_short", F.when(F.col("falls_short"), F.col("used_tokens")).otherwise(0).alias("used_bytes"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix_to_targets(_sources(spark, folder), table(spark, folder, "mix_targets"))[1]


def p8_uses(spark: SparkSession, folder: str) -> DataFrame:
    return mix_to_targets(_sources(spark, folder), table(spark, folder, "mix_targets"))[0]


def p8_temperature(spark: SparkSession, folder: str) -> DataFrame:
    return mix_by_temperature(_sources(spark, folder))[1]


# 9. look-alike texts


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(spill(lookalike_members(table(spark, folder, "documents")), "members"))


def p9_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every document whose text is also stored with other characters, with the first document of the same look."""
    return lookalike_classes(spill(lookalike_members(table(spark, folder, "documents")), "members"))


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one form of its text."""
    return consistent_text(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_annotators, p1_calibration, p1_agreement, p3_found, p4_found, p4_report, p4_margins, p4_sample, p5_found, p5_turns, p5_without_role, p6_found, p6_members, p6_splits,
        p6_report, p7_found, p7_containers, p7_split_by_bytes, p7_report, p8_found, p8_short_by_bytes, p8_report, p8_uses, p8_temperature, p9_found, p9_members, p9_forms,
    )
}

_ID = "regexp_replace(regexp_replace(lower(trim(session_id)), ':(mid|first)(180|300|120|60)?$', ''), '^(candor_|dc_|duplexchat_|duplex_)', '')"
_NONE = "('', '-', '--', '?', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'tbd', 'undefined', 'unknown')"
_VOTES = """
ranked as (
  select assignment_id, case when ratable and lower(trim(action)) in ('ack', 'repair', 'respond', 'wait') then lower(trim(action)) end as answer, submitted_at
  from assigned_annotations),
last as (select assignment_id, answer from ranked qualify row_number() over (partition by assignment_id order by submitted_at desc nulls last, answer desc nulls last) = 1),
votes as (
  select item_id as item, annotator_id as annotator, answer
  from (select distinct assignment_id, item_id, annotator_id from assignment_map where not is_repeat) join last using (assignment_id) where answer is not null)"""
_ACTIONS = ["ack", "repair", "respond", "wait"]


def _rounds(n: int) -> str:
    """The reweighted voting of p1_found as ``n`` rounds of plain SQL: far more than it takes until nothing moves."""
    text = [f"with {_VOTES.strip()}", "v as materialized (select item, annotator, max(answer) as answer from votes group by all)", "w0 as (select annotator, 1.0::double as weight from v group by all)"]
    for i in range(n):
        text.append(f"s{i} as (select item, count(*) as n, {', '.join(f"coalesce(sum(weight) filter (answer = '{a}'), 0) as {a}_" for a in _ACTIONS)} from v join w{i} using (annotator) group by all)")
        rest = [f"({a}_ - case when answer = '{a}' then weight else 0 end)" for a in _ACTIONS]
        text.append(f"r{i} as (select annotator, weight, answer, n, {', '.join(f'{r} as r_{a}' for r, a in zip(rest, _ACTIONS, strict=True))} from v join w{i} using (annotator) join s{i} using (item))")
        e = [f"exp(8.0 * (r_{a} - greatest({', '.join(f'r_{b}' for b in _ACTIONS)})))" for a in _ACTIONS]
        mine = " ".join(f"when '{a}' then {x}" for x, a in zip(e, _ACTIONS, strict=True))
        text.append(f"a{i} as (select annotator, any_value(weight) as old, (coalesce(sum(case when n > 1 then (case answer {mine} end) / ({' + '.join(e)}) end), 0) + 1) / (count(*) filter (n > 1) + 4) as acc from r{i} group by all)")
        kept = 0.3 if i >= 3 else 0.0
        text.append(f"w{i + 1} as materialized (select annotator, {kept} * old + {1 - kept} * ln(least(greatest(acc, 0.02), 0.98) * 3 / (1 - least(greatest(acc, 0.02), 0.98))) as weight from a{i})")
    return ",\n".join(text) + f"""
select item as item_id, answer as action from (select item, answer, sum(weight) as score, sum(count(*)) over (partition by item) as n from v join w{n} using (annotator) group by item, answer)
where n >= 3 qualify row_number() over (partition by item order by score desc, answer desc) = 1"""


def _turns_sql() -> str:
    """p5_found where every label is one of the list or of its two usual misspellings: roles by name, turns as runs."""
    names = {"user": [*USER_LABELS, "usre"], "assistant": [*ASSISTANT_LABELS, "asistant"]}
    every = sorted(sum(names.values(), []), key=len, reverse=True)
    label = "|".join(x.replace(" ", "\\s+") for x in every)
    role = lambda c: "case " + " ".join(f"when {c} in ({', '.join(repr(x) for x in xs)}) then '{r}'" for r, xs in names.items()) + " end"
    plain = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[:>\\-\\s]+$', ''), '\\s+', ' ', 'g'))"
    clock = "(?:\\d{1,3}:)?\\d{1,3}:\\d{2}(?:[.,]\\d{1,6})?"
    time = f"^\\s*(?:<\\s*{clock}\\s*>|[\\[(]?\\s*{clock}\\s*(?:[\\])]|-->(?:\\s*{clock})?|\\|)|\\d{{1,3}}:\\d{{2}}:\\d{{2}}(?:[.,]\\d{{1,6}})?(?:\\s|$)|[\\[<(]\\s*\\d+(?:\\.\\d+)?\\s*s(?:ec)?\\s*[\\])>]|@\\s*\\d+(?:\\.\\d+)?\\s*s?\\s*(?:\\||$))\\s*\\|?"
    mark = f"^\\s*(?:>>\\s*)?(?:[\\[<(]\\s*({label})\\s*[\\])>]\\s*:?|({label})\\s*(?:[:>]|-(?:\\s|$)))"
    span = "\\(\\([^()]*\\)\\)|\\[[^\\[\\]]*\\]|\\([^()]*\\)|<[^<>]*>|\\{[^{}]*\\}|\\*[^*]+\\*|♪[^♪]*♪?"
    return f"""
with a as (select distinct line_id, session_id, speaker, start_s, coalesce(text, '') as text from raw_turns where session_id is not null and line_id is not null),
b as (select *, regexp_extract(text, '{time}') as front, regexp_replace(text, '{time}', '') as rest from a),
c as (select *, regexp_extract(front, '(?:(\\d{{1,3}}):)?(\\d{{1,3}}):(\\d{{2}})(?:[.,](\\d{{1,6}}))?', ['h', 'm', 's', 'f']) as k, {role(plain("speaker"))} as named,
  coalesce(nullif(regexp_extract(rest, '{mark}', 1, 'i'), ''), regexp_extract(rest, '{mark}', 2, 'i')) as said from b),
d as (select *, case when k.m <> '' then coalesce(try_cast(nullif(k.h, '') as double), 0) * 3600 + try_cast(k.m as double) * 60 + try_cast(k.s as double) + coalesce(try_cast('0.' || nullif(k.f, '') as double), 0)
    when front <> '' then try_cast(regexp_extract(front, '\\d+(?:\\.\\d+)?') as double) when not isnan(start_s) and not isinf(start_s) then start_s end as t, {role(plain("said"))} as inside from c),
e as (select line_id, session_id, t, coalesce(named, inside) as role, regexp_replace(case when inside is not null and coalesce(named, inside) = inside then regexp_replace(rest, '{mark}', ' ', 'i') else rest end, '{span}', ' ', 'g') as spoken from d),
f as (select distinct session_id, t, line_id, role from e where t is not null and role is not null
  and len([x for x in regexp_extract_all(spoken, '[\\p{{L}}\\p{{N}}]+(?:[''’\\-][\\p{{L}}\\p{{N}}]+)*') if not regexp_full_match(lower(x), '{HESITATION}')]) > 0),
g as (select *, coalesce((role <> lag(role) over w)::int, 1) as opens from f window w as (partition by session_id order by t, line_id)),
h as (select *, sum(opens) over (partition by session_id order by t, line_id rows unbounded preceding) as n from g)
select session_id, role as turn_speaker, arg_min(line_id, (t, line_id)) as opening_line_id, count(distinct line_id) as n_lines from h group by session_id, role, n"""


SQL = {
    "p1_agreement": f"""
with {_VOTES},
n as (select item, answer, count(*) as n from votes group by all),
i as (select item, sum(n) as m, sum(n * n) as sq from n group by item having sum(n) >= 2),
o as (select count(*) as n_items, sum(m) as n_ratings, sum((m * m - sq) / (m - 1.0)) as d from i),
e as (select sum(n * n) as sq from (select answer, sum(n) as n from n join i using (item) group by answer))
select n_items, cast(n_ratings as bigint) as n_ratings, cast(1 - d * (n_ratings - 1) / (n_ratings * n_ratings - sq) as double) as alpha from o, e""",
    "p3_found": f"""
with e as (select distinct event_id, {_ID} as s, t from turn_events where t is not null and not isnan(t) and event_id is not null),
c as (select distinct chunk_id, {_ID} as s, signal_name as g, t_end from chunk_signals where t_end is not null and not isnan(t_end) and signal_name is not null),
b as (select *, cast(floor(t_end / 10) as bigint) as k from c),
near as (
  select event_id, chunk_id, g, abs(t_end - t) as d, t_end
  from (select *, unnest([cast(floor(t / 10) as bigint) - 1, cast(floor(t / 10) as bigint), cast(floor(t / 10) as bigint) + 1]) as k from e) x join b using (s, k)
  where abs(t_end - t) <= 0.12)
select event_id, chunk_id from near qualify row_number() over (partition by event_id, g order by d, t_end, chunk_id) = 1""",
    "p4_found": f"""
with usable as (
  select distinct checkpoint_id, lower(trim(source)) as source, lower(trim(lineage_id)) as lineage,
    case when elapsed_s < 1 then '<1s' when elapsed_s < 3 then '1-<3s' else '>=3s' end as elapsed_stratum
  from silence_checkpoints
  where elapsed_s >= 0 and not isnan(elapsed_s) and lower(trim(source)) not in {_NONE} and lower(trim(lineage_id)) not in {_NONE}),
s as (select count(distinct checkpoint_id) // 10 as n from usable),
per as (select source, elapsed_stratum, lineage, count(*) as n from usable group by all),
have as (select t.source, t.elapsed_stratum, sum(least(p.n, t.lineage_cap)) as available from sample_targets t join per p using (source, elapsed_stratum) group by all)
select t.source, t.elapsed_stratum from sample_targets t left join have h using (source, elapsed_stratum), s
where coalesce(available, 0) < greatest(min_rows, target_bp * s.n // 10000)""",
    "p6_found": f"""
with recursive e as (
  select distinct {_ID} as s, lower(trim(lineage_id)) as l from silence_checkpoints where lower(trim(lineage_id)) not in {_NONE}),
hop as (select distinct x.l as a, y.l as b from e x join e y using (s) where x.l <> y.l),
reach as (select a, b from hop union select r.a, h.b from reach r join hop h on r.b = h.a)
select distinct a as lineage_a, b as lineage_b from reach where a < b""",
    "p1_found": _rounds(15),
    "p6_members": f"""
with recursive e as (
  select distinct {_ID} as s, lower(trim(lineage_id)) as l from silence_checkpoints where lower(trim(lineage_id)) not in {_NONE}),
hop as (select distinct x.l as a, y.l as b from e x join e y using (s)),
reach as (select a, b from hop union select r.a, h.b from reach r join hop h on r.b = h.a),
own as (select distinct l from e)
select l as lineage, coalesce(min(b), l) as representative, greatest(count(distinct b), 1) as n_lineages from own left join reach on a = l group by l""",
    "p7_split_by_bytes": """
select doc_id, cast((strlen(text) + 2047) // 2048 as bigint) as n_pieces, cast(strlen(text) as bigint) as n_bytes, cast((strlen(text) + 2047) // 2048 as bigint) as n_containers
from documents where strlen(text) > 2048""",
    "p8_short_by_bytes": """
with d as (select lower(trim(source)) as source, coalesce(strlen(text), 0) as n from documents), t as (select sum(n) as total from d),
s as (select source, sum(n) as n from d group by source)
select m.source, cast(coalesce(n, 0) as bigint) as n_bytes, coalesce(n, 0) * max_repeats * 10000 < target_bp * total as falls_short,
  cast(case when coalesce(n, 0) * max_repeats * 10000 < target_bp * total then coalesce(n, 0) * max_repeats else 0 end as bigint) as used_bytes
from (select lower(trim(source)) as source, target_bp, max_repeats from mix_targets) m left join s using (source), t""",
    "p5_found": _turns_sql(),
}
