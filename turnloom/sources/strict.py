"""Readers that check what they read. Broken records come back as rows with the name of the rule, so that nothing is lost in silence
and nothing reaches the driver; ``require_none`` turns them into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.columns import norm_session

#: The keys under which a session may give the speech of a channel; exactly one of them has to be there.
CHANNEL_KEYS = {"user": ["user_vad", "user", "left", "LEFT"], "assistant": ["assistant_vad", "assistant", "agent_vad", "right", "RIGHT"]}
#: What a label line may say.
LABEL_ACTIONS = ["wait", "ack", "respond", "repair", "unratable"]
LABEL_QUALITIES = ["unreviewed", "clean", "breath_or_nonlexical", "noise_or_clipping", "dropout_mute_or_edit"]


def require_none(broken: DataFrame, what: str) -> None:
    """Raises with the first few broken rows, if there are any."""
    rows = broken.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def _number(text: Column) -> Column:
    """A JSON number (not a string or boolean), finite; else null."""
    return F.when(F.regexp_like(text, F.lit(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$")), text.cast("double"))


def strict_vad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, intervals, broken) of JSON lines with one session each.

    A session needs a non-empty session_id (unique), lineage_id and source, a positive duration_s, a boolean challenge
    if any, and for each channel exactly one of its keys with a list of [start, end] pairs or {start, end} objects:
    inside the session, start before end, without overlap within the channel. Broken: session_id, rule. Sessions and
    intervals are those of sessions that break nothing. Blank lines are skipped; a line that is no JSON object breaks 'object'.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    # raw field texts: a map keeps which keys are there at all
    f = lines.select("value", F.from_json("value", "map<string,string>").alias("f"), F.try_parse_json("value").alias("j"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("j", f"$.{k}", "variant"))
    text = lambda k: F.try_element_at("f", F.lit(k))
    duration = _number(text("duration_s"))
    columns = [text("session_id").alias("session_id"), text("lineage_id").alias("lineage_id"), text("source").alias("source"), duration.alias("duration_s"), F.coalesce(text("challenge"), F.lit("false")).alias("challenge")]
    rules: list[tuple[str, Column]] = [("object", F.col("f").isNotNull())]
    rules += [(c, F.coalesce((F.trim(text(c)) != "") & (kind(c) == "STRING"), F.lit(False))) for c in ("session_id", "lineage_id", "source")]
    rules += [("duration_s", F.coalesce((duration > 0) & (kind("duration_s") != "STRING"), F.lit(False))), ("challenge", F.coalesce(kind("challenge") == "BOOLEAN", ~F.map_contains_key("f", F.lit("challenge")), F.lit(False)))]
    for channel, keys in CHANNEL_KEYS.items():
        there = F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.map_contains_key("f", k))
        rules.append((f"{channel} alias", F.coalesce(F.size(there) == 1, F.lit(False))))
        raw = F.try_element_at("f", F.get(there, F.lit(0)))
        pairs = F.from_json(raw, "array<array<double>>")
        named = F.transform(F.from_json(raw, "array<struct<start_s double, end_s double, start double, end double>>"), lambda x: F.array(F.coalesce(x.start_s, x.start), F.coalesce(x.end_s, x.end)))
        is_named = F.regexp_like(raw, F.lit(r"^\s*\[\s*\{"))
        spans = F.when(is_named, named).otherwise(pairs)
        columns.append(F.array_sort(spans).alias(channel))
        rules.append((f"{channel} list", F.coalesce(F.forall(spans, lambda x: (F.size(x) == 2) & F.coalesce(F.get(x, F.lit(0)).isNotNull() & F.get(x, F.lit(1)).isNotNull() & ~F.isnan(F.get(x, F.lit(0))) & ~F.isnan(F.get(x, F.lit(1))), F.lit(False))), raw.isNull())))
    g = f.select("f", *columns, F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]).alias("r"))
    more = []
    for channel in CHANNEL_KEYS:
        c = F.col(channel)
        more.append(F.when(F.exists(c, lambda x: (F.get(x, F.lit(0)) < 0) | (F.get(x, F.lit(1)) > F.col("duration_s"))), F.lit(f"{channel} range")))
        more.append(F.when(F.exists(c, lambda x: F.get(x, F.lit(0)) >= F.get(x, F.lit(1))), F.lit(f"{channel} order")))
        follows = F.arrays_zip(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))).alias("a"), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))).alias("b"))
        more.append(F.when(F.exists(follows, lambda x: F.get(x.b, F.lit(0)) < F.get(x.a, F.lit(1))), F.lit(f"{channel} overlap")))
    g = g.withColumn("r", F.array_compact(F.concat("r", F.array(*more))))
    repeated = g.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("session_id")
    broken = g.select("session_id", F.explode("r").alias("rule")).unionByName(repeated.withColumn("rule", F.lit("unique"))).distinct()
    good = g.where(F.size("r") == 0).join(repeated, "session_id", "left_anti")
    each = None
    for channel in CHANNEL_KEYS:
        part = good.select("session_id", F.lit(channel).alias("channel"), F.explode(channel).alias("x")).select("session_id", "channel", F.get("x", F.lit(0)).alias("start_s"), F.get("x", F.lit(1)).alias("end_s"))
        each = part if each is None else each.unionByName(part)
    return good.select("session_id", "lineage_id", "source", "duration_s", (F.col("challenge") == "true").alias("challenge")), each, broken


def label_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, broken) of JSON lines with one label each. Broken: file, line (from 1, blank lines count), rule.

    Files of labels are small and written by people: each is read whole by one task, so that a line has a number.
    Lenient in what may be missing (tags, alternates, confidence, onset), strict in the names of actions and qualities.
    A label that occurs twice (episode, elapsed time, annotator) breaks 'repeated' on every line but the first.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^.*/", "").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text").where("trim(text) <> ''")
    schema = "episode_id string, checkpoint_elapsed_s double, annotator string, action string, quality string, ratable boolean, confidence int, also_acceptable array<string>, tags array<string>, _bad string"
    parsed = lines.select("file", "line", "text", F.from_json("text", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("o")).select("file", "line", "text", "o.*")
    parsed = parsed.withColumn("n", F.row_number().over(Window.partitionBy("episode_id", "checkpoint_elapsed_s", "annotator").orderBy("file", "line")))
    ok = F.col("_bad").isNull() & F.col("text").startswith("{")
    rules = F.when(~ok, "object").when(~F.coalesce(F.col("action").isin(LABEL_ACTIONS), F.lit(False)), "action").when(~F.coalesce(F.col("quality").isin(LABEL_QUALITIES), F.lit(False)), "quality")
    rules = rules.when(F.exists(F.coalesce("also_acceptable", F.array().cast("array<string>")), lambda a: ~a.isin(LABEL_ACTIONS)), "also_acceptable").when(F.col("n") > 1, "repeated")
    marked = parsed.withColumn("rule", rules)
    return marked.where("rule is null").drop("rule", "n", "_bad", "text"), marked.where("rule is not null").select("file", "line", "rule")


def named_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(name, path, n_bytes) of the files below ``path`` that end in ``suffix``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), "\\Q" + suffix + "\\E$", "").alias("name"), "path", F.col("length").alias("n_bytes"))


def resolved(ids: DataFrame, names: DataFrame, id_col: str = "session_id", name: str = "name") -> DataFrame:
    """Adds to each id the name it resolves to: the id itself, or else the first (in order) with the same normal form; null if none.

    ``names``: name and whatever else, kept for the chosen row. One equi-join on the normal form; the choice is an aggregation.
    """
    rest = [c for c in names.columns if c != name]
    known = names.select(F.col(name).alias("_name"), F.struct(*[F.col(c) for c in [name, *rest]]).alias("_row"), norm_session(name).alias("_normal"))
    asked = ids.select(id_col).distinct().withColumn("_normal", norm_session(id_col))
    best = asked.join(known, "_normal").groupBy(id_col).agg(F.min_by("_row", F.struct(F.col("_name") != F.col(id_col), "_name")).alias("_row"))
    return ids.join(best, id_col, "left").select(*ids.columns, F.col(f"_row.{name}").alias(name), *[F.col(f"_row.{c}").alias(c) for c in rest])


def archive_breaks(archive: DataFrame, splits: DataFrame, vectors: list[str]) -> DataFrame:
    """(row_id, rule) of a feature archive: vectors all there, finite and of one width, nothing available after the cutoff, and every
    lineage in the split it is bound to. ``archive``: row_id, lineage_id, split, available_at_s, model_cutoff_s, the vectors;
    ``splits``: lineage_id, split."""
    widths = archive.agg(*[F.min(F.size(x)).alias(x) for x in vectors])  # one row
    bound = splits.select("lineage_id", F.col("split").alias("_bound"))
    j = archive.join(bound, "lineage_id", "left").crossJoin(widths.select(*[F.col(x).alias(f"_w_{x}") for x in vectors]))
    finite = lambda x: F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    rules = [("causal", F.col("available_at_s") <= F.col("model_cutoff_s") + 1e-9), ("split", F.col("split") == F.col("_bound"))]
    for x in vectors:
        rules += [(f"{x} finite", finite(F.col(x))), (f"{x} width", F.size(x) == F.col(f"_w_{x}"))]
    return j.select("row_id", F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules]))).alias("rule"))


def natural(name: Column | str, width: int = 12) -> Column:
    """Sort key in which runs of digits count as numbers (layer2 before layer10): each is padded to ``width`` digits."""
    c = F.col(name) if isinstance(name, str) else name
    parts = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(F.regexp_like(x, F.lit(r"^\d+$")), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), width, "0")).otherwise(x)), "")


def horizons_of(lock: str | dict) -> list[int]:
    """The grid of horizons in frames that a selection lock names: a number, a list, or either nested under known keys."""
    import json

    body = json.loads(lock) if isinstance(lock, str) else lock
    found: list[int] = []

    def walk(x: object, named: bool) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, named or k in HORIZON_KEYS)
        elif isinstance(x, list):
            for v in x:
                walk(v, named)
        elif named:
            if isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x) or x <= 0:
                raise ValueError(f"{x!r} is no horizon")
            found.append(int(x))

    walk(body, False)
    if not found:
        raise ValueError("the lock names no horizon")
    return sorted(set(found))


#: Keys under which a selection lock gives horizons.
HORIZON_KEYS = ["H_set", "horizon_frames", "horizons", "H", "frames", "values"]
