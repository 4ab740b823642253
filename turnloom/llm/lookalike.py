"""One form for texts that look the same, on arrays of code points.

A batch of texts is decoded once as a whole into a numpy array of code points. A table indexed by code point says how
long each one's replacement is and where it stands; gathers and repeated offsets write all replacements at once. Marks
are put in canonical order and composed with their bases by sorted-table search, again for the whole batch.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other alphabets that look like a Latin letter, in pairs (letter, Latin letter).
LOOKALIKES = """
Greek: ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa οo νv ρp χx ϲc ϳj ϹC ϺM
Cyrillic: АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ԜW ԚQ ԌG ӀI ҺH ѵv ѴV
Armenian: ոn սu օo հh ցg ՕO ՍU ՏS
Latin: ɑa ɡg ᴏo ᴄc ᴠv ᴡw ᴢz ꜱs
"""
#: Marks that look the same: hyphens that look like the hyphen-minus, the division slash and its kin.
SAME_MARKS = {"‐": "-", "‑": "-", "⁃": "-", "∕": "/", "⁄": "/", "ꞏ": "·", "‧": "·", "∶": ":", "꞉": ":", "ʹ": "'"}
#: Compatibility characters of these kinds look the same as what they stand for; superscripts, fractions and circles don't.
SAME_KINDS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Characters that are not seen but aren't of the category Cf: fillers and variation selectors, as ranges.
UNSEEN = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]

#: Bytes of text that are worked on at once (a longer text alone).
SHARE_BYTES = 1 << 20

_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00  # Hangul composition is by rule

_tables: dict[str, tuple] = {}


def _pairs() -> dict[int, str]:
    out = {}
    for line in LOOKALIKES.strip().splitlines():
        for pair in line.partition(":")[2].split():
            if len(pair) == 2:
                out[ord(pair[0])] = pair[1]
    return out | {ord(a): b for a, b in SAME_MARKS.items()}


def _replacement(cp: int, pairs: dict[int, str], depth: int = 0) -> str:
    """Full decomposition of one code point, with look-alikes replaced."""
    ch = chr(cp)
    if depth > 12:
        return ch
    if cp in pairs and pairs[cp] != ch:
        return "".join(_replacement(ord(c), pairs, depth + 1) for c in pairs[cp])
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return " "
    if kind in ("Zl", "Zp") or cp == 0x85:
        return "\n"
    if kind == "Cc":
        return ch if ch in "\t\n" else ""
    if kind == "Cf" or any(a <= cp <= b for a, b in UNSEEN):
        return ""
    made_of = unicodedata.decomposition(ch)
    if made_of:
        tag, _, rest = made_of.partition("> ") if made_of[0] == "<" else ("", "", made_of)
        parts = [int(x, 16) for x in rest.split()]
        spacing_mark = tag and parts[0] == 0x20 and len(parts) > 1  # a free-standing accent isn't a blank with an accent
        if not tag or (tag + ">" in SAME_KINDS and not spacing_mark):
            return "".join(_replacement(p, pairs, depth + 1) for p in parts)
    return ch


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, offset, pool, combining class, keys of base and mark, composed) for all code points; built once a process."""
    if "t" not in _tables:
        pairs = _pairs()
        n = sys.maxunicode + 1
        length, offset, ccc = np.ones(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.uint8)
        pool: list[int] = []
        compose: dict[int, int] = {}
        for cp in range(n):
            if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF or 0x4E00 <= cp <= 0x9FFF or 0x20000 <= cp <= 0xE0000 and not 0x2F800 <= cp <= 0x2FA1F or cp >= 0xF0000:
                offset[cp] = -1  # nothing to replace
                continue
            ch = chr(cp)
            ccc[cp] = unicodedata.combining(ch)
            new = _replacement(cp, pairs)
            if new == ch:
                offset[cp] = -1
            else:
                length[cp], offset[cp] = len(new), len(pool)
                pool.extend(map(ord, new))
            made_of = unicodedata.decomposition(ch)
            if made_of and made_of[0] != "<" and " " in made_of and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in made_of.split())
                if a not in pairs:
                    compose[a << 21 | b] = cp
        keys = np.array(sorted(compose), np.int64)
        _tables["t"] = (length, offset, np.array(pool or [0], np.uint32), ccc, keys, np.array([compose[k] for k in keys.tolist()], np.uint32))
    return _tables["t"]


def _expand(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length, offset, pool, *_ = tables()
    reps = length[cps]
    if (offset[cps] < 0).all():
        return cps, row
    src = np.repeat(np.arange(len(cps)), reps)
    step = np.arange(len(src)) - np.repeat(np.cumsum(reps) - reps, reps)
    out, at = cps[src], offset[cps[src]]
    swap = at >= 0
    out[swap] = pool[at[swap] + step[swap]]
    return out, row[src]


def _order_marks(cps: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Canonical order: marks between two starters by rising combining class, stable."""
    ccc = tables()[3][cps]
    wrong = (ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1])
    if not wrong.any():
        return cps
    run = np.cumsum((ccc == 0) | np.concatenate([[True], row[1:] != row[:-1]]))
    touched = np.isin(run, run[1:][wrong])
    at = np.flatnonzero(touched)
    cps = cps.copy()
    cps[at] = cps[at[np.lexsort((np.arange(len(at)), ccc[at], run[at]))]]
    return cps


def _compose(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks join their base where the pair has a composed character; marks blocked by an equal class stay."""
    _, _, _, ccc, keys, made = tables()
    cps = cps.copy()
    n = len(cps)
    if not n:
        return cps, row
    kind = ccc[cps]
    begins = np.concatenate([[True], row[1:] != row[:-1]])
    starter = (kind == 0) | begins
    base = np.maximum.accumulate(np.where(starter, np.arange(n), 0))
    gone = np.zeros(n, bool)
    marks = np.flatnonzero((kind > 0) & ~starter & (kind[base] == 0))
    rank = np.zeros(0, np.int64)
    if len(marks):
        first = np.concatenate([[True], base[marks][1:] != base[marks][:-1]])
        rank = np.arange(len(marks)) - np.maximum.accumulate(np.where(first, np.arange(len(marks)), 0))
    last = np.zeros(n, np.uint8)  # class of the last mark of each base that stayed
    for k in range(int(rank.max()) + 1 if len(rank) else 0):  # the first mark of every base at once, then the second ...
        m = marks[rank == k]
        b = base[m]
        key = cps[b].astype(np.int64) << 21 | cps[m].astype(np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = (keys[at] == key) & (last[b] < kind[m])
        cps[b[ok]] = made[at[ok]]
        gone[m[ok]] = True
        last[b[~ok]] = kind[m[~ok]]
    keep = ~gone
    cps, row = cps[keep], row[keep]
    for lead, count, follow, many in ((_L, 19, _V, 21), (_S, 11172, _T, 28)):  # Hangul: first with second, then with third
        if len(cps) < 2:
            break
        a, b = cps[:-1].astype(np.int64) - lead, cps[1:].astype(np.int64) - follow
        ok = (a >= 0) & (a < count) & (b >= (1 if lead == _S else 0)) & (b < many) & (row[1:] == row[:-1])
        if lead == _S:
            ok &= a % 28 == 0
        at = np.flatnonzero(ok)
        if len(at):
            cps = cps.copy()
            cps[at] = (_S + (a[at] * 21 + b[at]) * 28) if lead == _L else (_S + a[at] + b[at])
            keep = np.ones(len(cps), bool)
            keep[at + 1] = False
            cps, row = cps[keep], row[keep]
    return cps, row


def fold(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and their row numbers (rising) in; the same of the consistent forms out."""
    cps, row = _expand(cps, row)
    return _compose(_order_marks(cps, row), row)


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column, and the row of each. One decoding for the whole column."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    starts = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])
    bounds = before[offsets - offsets[0]]
    try:
        cps = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    except UnicodeDecodeError:  # bytes that are no text become U+FFFD, text by text, so that the rows stay apart
        ends = (offsets - offsets[0]).tolist()
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return cps, np.repeat(np.arange(len(column), dtype=np.int32), np.diff(bounds))


def _strings(cps: np.ndarray, row: np.ndarray, n: int, valid: pa.Array) -> pa.Array:
    """The inverse: one encoding for the whole column, then offsets."""
    cps = np.where((cps >= 0xD800) & (cps < 0xE000), 0xFFFD, cps)  # lone surrogates can't be stored
    raw = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, weights=width, minlength=n).astype(np.int64))])
    plain = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw)])
    import pyarrow.compute as pc

    return pc.if_else(valid, plain, pa.scalar(None, pa.large_string())).cast(pa.string())


def _shares(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SHARE_BYTES`` of text each: a code point takes some thirty times its byte on the way."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(np.diff(np.cumsum(sizes) // SHARE_BYTES, prepend=0))
    cuts = [0, *at[at > 0].tolist(), len(column)]
    return ((a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def consistent_text(docs: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """``docs`` with ``out``: the consistent form of ``text``. Null stays null, empty stays empty; any length.

    Invisible characters (controls too, but for tab and line feed) vanish; all kinds of spaces become the blank; full-width, ligature and font forms become plain
    letters; look-alikes of other alphabets become Latin; marks are in canonical order, composed where Unicode has the
    composed letter. Letter case, accents, punctuation, line ends and the number of spaces stay. The form is for
    comparisons: in running Cyrillic or Greek text it holds Latin letters where they look the same. A clashing column
    ``out`` is replaced; all other columns and repeated rows stay.
    """
    rest = docs.drop(out) if out != text else docs
    names = rest.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in _shares(whole.column(at)):
                batch = whole.slice(a, b - a)
                column = batch.column(at)
                cps, row = _code_points(column.fill_null(""))
                cps, row = fold(cps, row)
                yield pa.RecordBatch.from_arrays([*batch.columns, _strings(cps, row, batch.num_rows, column.is_valid())], names=[*names, out])

    return rest.mapInArrow(run, rest.withColumn(out, F.col(text)).schema)


def _fingerprint(c: str):
    """128 bits of a text, so that comparisons don't move texts."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(c, F.lit(71)).alias("b"))


def lookalike_members(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, form, stored): fingerprints of the consistent form and of the stored text. Null, empty and blank texts are left out."""
    forms = consistent_text(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text <> ''"), "text", "form")
    return forms.where("trim(form) <> ''").select("id", _fingerprint("form").alias("form"), _fingerprint("text").alias("stored"))


def lookalike_pairs(members: DataFrame) -> DataFrame:
    """(doc_a, doc_b), smaller id first: same form, different stored text.

    Forms with one stored text only are dropped first, by an aggregation whose map side collapses copies; so exact
    copies meet only where another spelling of them exists.
    """
    spellings = members.groupBy("form").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low <> high").select("form")
    mixed = members.join(spellings, "form", "left_semi")
    a = mixed.select("form", F.col("id").alias("doc_a"), F.col("stored").alias("sa"))
    b = mixed.select("form", F.col("id").alias("doc_b"), F.col("stored").alias("sb"))
    return a.join(b, "form").where("doc_a < doc_b and sa <> sb").select("doc_a", "doc_b")


def lookalike_classes(members: DataFrame) -> DataFrame:
    """(doc_id, representative, n_documents, n_spellings) of the documents whose form is stored in more than one way: one row per document."""
    ends = members.groupBy("form", "stored").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = ends.groupBy("form").agg(F.min("first").alias("representative"), F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_spellings")).where("n_spellings > 1")
    return members.join(classes, "form").select(F.col("id").alias("doc_id"), "representative", "n_documents", "n_spellings")
