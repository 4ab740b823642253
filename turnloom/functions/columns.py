"""Column expressions for ids, labels, kinds, buckets and times. Everything stays in the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that trimming removes, corpus prefixes, window tags, event kinds and their spellings.
BLANKS = " \t\n\r\f\u000b "
SESSION_PREFIXES = ["candor_", "dc_", "duplexchat_", "duplex_"]
WINDOW_MODES = ["mid", "first"]
WINDOW_SECONDS = [180, 300, 120, 60]
EVENT_KINDS = ["turn_shift", "backchannel", "barge_in"]
KIND_SPELLINGS = {
    "turn_shift": "turn_shift", "turnshift": "turn_shift", "turn-shift": "turn_shift", "shift": "turn_shift", "turn": "turn_shift",
    "backchannel": "backchannel", "back_channel": "backchannel", "back-channel": "backchannel", "bc": "backchannel",
    "barge_in": "barge_in", "bargein": "barge_in", "barge-in": "barge_in", "overlap": "barge_in",
}
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "tbd", "undefined", "unknown"]


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space at both ends (tabs and line ends too, unlike plain trim)."""
    return F.btrim(col_of(c), F.lit(BLANKS))


def tidy(c: Column | str) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(trimmed(c))


def known(c: Column | str) -> Column:
    """``tidy`` value, or null where it is missing, blank or a placeholder."""
    return F.when(~tidy(c).isin(PLACEHOLDERS), tidy(c))


def strip_window(c: Column | str) -> Column:
    modes, seconds = "|".join(WINDOW_MODES), "|".join(map(str, WINDOW_SECONDS))
    return F.regexp_replace(col_of(c), f":({modes})({seconds})?$", "")


def strip_prefix(c: Column | str) -> Column:
    return F.regexp_replace(col_of(c), f"(?i)^({'|'.join(SESSION_PREFIXES)})", "")


def norm_session(c: Column | str) -> Column:
    """Session id without window suffix and corpus prefix, in lower case; null if nothing is left."""
    done = strip_prefix(strip_window(tidy(c)))
    return F.when(done != "", done)


def session_from_file(c: Column | str) -> Column:
    """File name to session id: folders, extension, then the endings a transcript export adds, then the prefix."""
    name = F.regexp_replace(col_of(c), r"^.*/", "")
    name = F.regexp_replace(name, r"\.[^.]*$", "")
    for ending in ["_transcript", "_transcription", "_turns", "_vad"]:
        name = F.regexp_replace(name, ending + "$", "")
    return strip_prefix(name)


def event_kind(c: Column | str) -> Column:
    """Canonical kind of an event, null if the spelling is unknown."""
    key = F.regexp_replace(tidy(c), " ", "_")
    return F.create_map(*[F.lit(x) for x in chain(*KIND_SPELLINGS.items())])[key]


def speaker_or_unknown(c: Column | str) -> Column:
    return F.coalesce(F.nullif(tidy(c), F.lit("")), F.lit("unknown"))


def finite(c: Column | str) -> Column:
    """The number, or null where it is null, NaN or infinite."""
    x = col_of(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_ms(c: Column | str) -> Column:
    """Whole milliseconds, half away from zero; null for what is no finite number or too large for doubles to tell
    milliseconds apart (9e12 s, some 285,000 years). Seconds since 1970 are well inside."""
    x = finite(c)
    return F.when(F.abs(x) < 9e12, F.round(x * 1000).cast("bigint"))


def first_of(df: DataFrame, aliases: list[str]) -> Column:
    """First non-null of the alias columns that the frame has."""
    have = [F.col(a) for a in aliases if a in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def half_up(c: Column | str) -> Column:
    return F.floor(col_of(c) + 0.5)


def half_even(c: Column | str) -> Column:
    return F.rint(col_of(c)).cast("bigint")


def bucket(c: Column | str, bounds: list[float]) -> Column:
    """Index of the first bound above the value; values beyond all bounds get the last index plus one."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(col_of(c) < bounds[i], i).otherwise(out)
    return out


def hash_share(*parts: Column | str) -> Column:
    """A number in [0, 1) from sha256 of the joined parts: the same everywhere, for splits and draws."""
    joined = F.concat_ws(":", *[col_of(p).cast("string") for p in parts])
    head = F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return head.cast("double") / F.lit(2.0**64)
