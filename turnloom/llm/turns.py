"""Clean speaker turns from transcript lines, by a semi-Markov conditional model over whole turns.

A segmentation cuts a session's lines into turns of alternating roles. The score of a turn of n lines is what its lines'
labels say for its role, what each pause and each pair of neighbouring lines inside it say for one turn going on, and a
score of its length: ``stay[k]`` for going on after k lines (the last one for all greater k). The best segmentation under
fitted weights decides every row. Nothing limits a turn's length.

A label is evidence, not truth: listed names, names close to a listed one and missing labels have weights of their own,
fitted with a part of the listed labels hidden or misspelt. A line is *sure* if the score of its label exceeds all that
its neighbours can ever say against it; then every best segmentation agrees with the label. Where two neighbouring sure
lines differ, a turn begins for certain, and both sides can be decoded apart: so a session is decoded in pieces of time,
and only the lines at the ends of a piece go on to longer pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.columns import BLANKS, finite
from turnloom.runtime import spill

#: Speaker labels of the two roles; left and channel 0 are the user, right and channel 1 the assistant.
USER_LABELS = ["user", "usr", "u", "human", "caller", "customer", "client", "left", "l", "ch0", "ch 0", "channel 0", "channel_0", "spk0", "spk 0", "spk_0", "speaker0", "speaker 0", "speaker_0"]
ASSISTANT_LABELS = ["assistant", "asst", "a", "agent", "bot", "system", "right", "r", "ch1", "ch 1", "channel 1", "channel_1", "spk1", "spk 1", "spk_1", "speaker1", "speaker 1", "speaker_1"]
#: Hesitation sounds, as a pattern; a longer word or a hyphenated one (uh-huh, mm-hm) is none.
HESITATION = r"(?:u+h+m*|u+m+|e+r+m*|e+h+m*|a+h+m+|h+m+|m+h*)"
#: Words that open a continuation, and short acknowledgements; both are speech.
CONTINUERS = ["and", "and then", "but", "so", "or", "because", "then"]
ACKNOWLEDGEMENTS = ["yeah", "uh-huh", "mm-hm", "right", "okay", "sure", "exactly", "i see", "got it", "go on", "of course", "fair enough", "really", "no way", "oh no"]
#: A label at least this close to a listed one (1 is equal) counts as a misspelling; shorter ones than four characters don't.
CLOSE, SHORT = 0.65, 4

# a time in front of a line, in the forms of subtitles, logs and players; the last groups are seconds alone
_TIME = re.compile(
    r"\s*(?:[\[<(]?\s*(?:([0-9]{1,3}):)?([0-9]{1,3}):([0-9]{2})(?:[.,]([0-9]{1,6}))?\s*(?:[\])]|>(?!>)|-->(?:\s*[0-9]{1,3}:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]{1,6})?)?|\|)"
    r"|([0-9]{1,3}):([0-9]{2}):([0-9]{2})(?:[.,]([0-9]{1,6}))?(?=\s|$)"
    r"|[\[<(]\s*([0-9]+(?:\.[0-9]+)?)\s*s(?:ec)?\s*[\])>]|@\s*([0-9]+(?:\.[0-9]+)?)\s*s?\s*(?:\||$))\s*\|?"
)
_LABEL = re.compile(r"\s*(?:>>\s*)?(?:[\[<(]\s*([^\[\]<>():\n]{1,24}?)\s*[\])>]\s*:?|([^\W\d][\w ]{0,23}?)\s*(?:[:>]|-(?=\s|$)))")
_NOISE = re.compile(
    r"\(\([^()\n]*\)\)|\[[^\[\]\n]*\]|\([^()\n]*\)|<[^<>\n]*>|\{[^{}\n]*\}|\*[^*\n]+\*|♪[^♪\n]*♪?"
    rf"|(?=[ueahm])(?<![^\W_])(?<![^\W_]['’-]){HESITATION}(?![^\W_])(?!['’-][^\W_])(?:\.\.\.|…|,)?",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_OPENER = re.compile(rf"(?i)(?:{'|'.join(sorted(CONTINUERS, key=len, reverse=True))})\b")
_ACKNOWLEDGED = re.compile(rf"(?i)(?:{'|'.join(re.escape(a) for a in ACKNOWLEDGEMENTS)})\b")

_known: dict[str, tuple[int, float]] = {}


def _closeness(a: str, b: str) -> float:
    """1 for equal strings, less by the edits (one per insertion, deletion, change or swap of neighbours) over the longer length."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return 1 - one[-1] / max(len(a), len(b), 1)


def evidence(label: str | None) -> tuple[int, float]:
    """(listed, close) of a label, each above 0 for the user and below 0 for the assistant; both 0 for an unknown one."""
    if not label:
        return 0, 0.0
    clean = " ".join(label.strip(BLANKS).lower().rstrip(":>- \t").split())
    if clean not in _known:
        if len(_known) > 100_000:
            _known.clear()
        near = 0.0
        if SHORT <= len(clean) <= 24:
            u, a = (max(_closeness(clean, x) for x in names if len(x) >= SHORT) for names in (USER_LABELS, ASSISTANT_LABELS))
            near = u - a if max(u, a) >= CLOSE else 0.0
        _known[clean] = (1, 0.0) if clean in USER_LABELS else (-1, 0.0) if clean in ASSISTANT_LABELS else (0, near)
    return _known[clean]


def _seconds(m: re.Match) -> float:
    g = m.groups()
    if g[8] or g[9]:
        return float(g[8] or g[9])
    h, mi, s, f = g[:4] if g[2] else g[4:8]
    return float(h or 0) * 3600 + float(mi) * 60 + float(s) + (float("0." + f) if f else 0.0)


def parse(texts: list[str | None], speakers: list[str | None]) -> tuple[list, list, list, list]:
    """(time or None, listed, close, clean text) of each line. The patterns for spans and hesitations run over all texts at once."""
    times, listed, close, rest = [], [], [], []
    for text, speaker in zip(texts, speakers, strict=True):
        e, c = evidence(speaker)
        t, at = None, 0
        if text:
            while m := _TIME.match(text, at):
                t = _seconds(m) if t is None else t
                at = m.end()
                if m.start() == at:
                    break
            m = _LABEL.match(text, at)
            if m:
                inside = evidence(m.group(1) or m.group(2))
                says, named = inside[0] or inside[1], e or c
                if says and (not named or (says > 0) == (named > 0)):
                    at = m.end()
                    e, c = (e, c) if named else inside
            text = text[at:].replace("\n", " ") if at or "\n" in text else text
        times.append(t)
        listed.append(e)
        close.append(c)
        rest.append(text or "")
    if not rest:
        return times, listed, close, []
    whole = "\n".join([" ".join(x.split()) for x in _NOISE.sub(" ", "\n".join(rest)).split("\n")])
    for mark in ",.?!;:":
        whole = whole.replace(" " + mark, mark)
    return times, listed, close, [x.removeprefix(">>").lstrip(",;:.- ") for x in whole.split("\n")]


def count_words(clean: str) -> int:
    """Words of a cleaned line; in longer ones the pieces between blanks, as only few or none make a difference."""
    return len(_WORD.findall(clean)) if len(clean) < 24 else clean.count(" ") + 1 if _WORD.search(clean) else 0


LINE = "session_id string, line_id bigint, t double, listed int, close double, words int, opener boolean, ended boolean, acknowledges boolean, clean string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):  # some megabytes of text in Python at once
            b = whole.slice(at, 2048)
            times, listed, close, clean = parse(b["text"].to_pylist(), b["speaker"].to_pylist())
            start = b["start_s"].to_pylist()
            columns = [
                b["session_id"], b["line_id"], pa.array([s if t is None else t for t, s in zip(times, start, strict=True)], pa.float64()), pa.array(listed, pa.int32()), pa.array(close, pa.float64()),
                pa.array([count_words(x) for x in clean], pa.int32()), pa.array([_OPENER.match(x) is not None for x in clean]), pa.array([x[-1:] in ".?!" and x != "" for x in clean]),
                pa.array([_ACKNOWLEDGED.match(x) is not None for x in clean]), pa.array(clean, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LINE.split(", ")])


def read_lines(lines: DataFrame) -> DataFrame:
    """Raw lines with ``t`` (seconds), the evidence of the label (``listed``, ``close``), ``clean`` text and ``words`` left in it.

    ``lines``: line_id, session_id, speaker, start_s, text; other columns are dropped. A time in front of the text is
    the line's start and wins over ``start_s``. A label in front of the text counts where the speaker column names no
    role. Sound annotations (any bracketed or starred span) and hesitations are removed. A null text has no words.
    """
    plain = lines.select(F.col("session_id").cast("string"), F.col("line_id").cast("bigint"), F.col("speaker").cast("string"), finite("start_s").alias("start_s"), F.col("text").cast("string"))
    return plain.mapInArrow(_read, LINE)


#: What is looked at between two lines, each in 0 to its bound: pause, long pause, short lines, a sentence's end, openers.
BOUNDARY = {"pause": 4.2, "long_pause": 1.0, "short_before": 1.0, "short_now": 1.0, "ended": 1.0, "opener": 1.0, "acknowledges": 1.0}
AGES = 3
N_WEIGHTS = 2 + len(BOUNDARY) + AGES  # listed, close; boundary; stay


def features(t, words, ended, opener, acknowledges) -> np.ndarray:
    """Boundary features of each line and the one before it, in the order given (that of the first line means nothing)."""
    before = lambda x: np.concatenate([np.asarray(x)[:1], np.asarray(x)[:-1]])
    pause = np.clip(np.asarray(t, float) - before(np.asarray(t, float)), 0, 60)
    words = np.asarray(words)
    return np.stack([np.log1p(pause), pause > 8, before(words) <= 2, words <= 2, before(np.asarray(ended, bool)), np.asarray(opener, bool), np.asarray(acknowledges, bool)], 1).astype(float)


def _likelihood(w: np.ndarray, e: np.ndarray, f: np.ndarray, role: np.ndarray, age: np.ndarray, stays: np.ndarray, live: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the roles and its gradient, over sequences padded to one length (arrays of sequence x line)."""
    g, n = role.shape
    diff, bound, stay = e @ w[:2], f @ w[2:-AGES], w[-AGES:]
    emit = np.exp(np.clip(np.stack([diff, -diff], 2) / 2, -40, 40))  # sequence, line, role
    go = np.exp(np.clip(bound[:, :, None] + stay, -40, 40))  # sequence, line, age
    alpha, scale = np.zeros((n, g, 2, AGES)), np.ones((n, g))
    alpha[0, :, :, 0] = emit[:, 0]
    for i in range(n):
        if i:
            on = alpha[i - 1] * go[:, i, None, :]
            alpha[i, :, :, 0] = alpha[i - 1].sum(2)[:, ::-1]
            alpha[i, :, :, 1:] = on[:, :, :-1]
            alpha[i, :, :, -1] += on[:, :, -1]
            alpha[i] *= emit[:, i, :, None]
            alpha[i] = np.where(live[:, i, None, None], alpha[i], alpha[i - 1])
        scale[i] = alpha[i].sum((1, 2))
        alpha[i] /= scale[i][:, None, None]
    beta, p_user, p_stay = np.ones((g, 2, AGES)), np.zeros((g, n)), np.zeros((g, n, AGES))
    for i in range(n - 1, -1, -1):
        both = alpha[i] * beta
        p_user[:, i] = (both.sum(2) / both.sum((1, 2))[:, None])[:, 0]
        if i:
            ahead = beta * emit[:, i, :, None] / scale[i][:, None, None]
            after = np.concatenate([ahead[:, :, 1:], ahead[:, :, -1:]], 2) * go[:, i, None, :]
            p_stay[:, i] = (alpha[i - 1] * after).sum(1)
            back = after + ahead[:, ::-1, :1]
            beta = np.where(live[:, i, None, None], back, beta)
    gold = np.where(role == 0, diff, -diff) / 2 + np.where(stays, bound + stay[age], 0)
    value = (gold * live).sum() - np.log(scale).sum()
    first = live.copy()
    first[:, 0] = False
    extra = (stays[:, :, None] * (age[:, :, None] == np.arange(AGES)) - p_stay) * first[:, :, None]
    return value, np.concatenate([np.einsum("gn,gnk->k", ((role == 0) - p_user) * live, e), np.einsum("gn,gnk->k", extra.sum(2), f), extra.sum((0, 1))])


def train(sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ridge: float = 0.02, steps: int = 40) -> np.ndarray:
    """Weights of greatest penalised conditional likelihood, by BFGS. ``sequences``: (label evidence, boundary features, roles) of each."""
    w = np.zeros(N_WEIGHTS)
    if not sequences:
        w[:2] = 20.0
        return w
    n = max(len(r) for *_, r in sequences)
    g = len(sequences)
    e, f, role, age = np.zeros((g, n, 2)), np.zeros((g, n, len(BOUNDARY))), np.zeros((g, n), int), np.zeros((g, n), int)
    stays, live = np.zeros((g, n), bool), np.zeros((g, n), bool)
    for k, (ev, bf, r) in enumerate(sequences):
        m = len(r)
        e[k, :m], f[k, :m], role[k, :m], live[k, :m] = ev, bf, r, True
        stays[k, 1:m] = r[1:] == r[:-1]
        run = 0
        for i in range(1, m):  # lines of the turn before line i, less one
            run = run + 1 if i > 1 and stays[k, i - 1] else 0
            age[k, i] = min(run, AGES - 1)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = _likelihood(w, e, f, role, age, stays, live)
        return ridge * w @ w / 2 - value, ridge * w - gradient

    value, gradient = loss(w)
    inverse = np.eye(N_WEIGHTS) / max(1.0, np.abs(gradient).max())
    for _ in range(steps):
        d = -inverse @ gradient
        d *= min(1.0, 3.0 / max(np.abs(d).max(), 1e-12))  # one step on a flat side mustn't run away
        step, slope = 1.0, gradient @ d
        while step > 1e-6:
            after, turned = loss(w + step * d)
            if after <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, turned - gradient
        w, value, gradient = w + s, after, turned
        if np.abs(gradient).max() < 1e-3 * g:
            break
        if s @ y > 1e-12:
            r = np.eye(N_WEIGHTS) - np.outer(s, y) / (s @ y)
            inverse = r @ inverse @ r.T + np.outer(s, s) / (s @ y)
    return w


def decode(diff: np.ndarray, bound: np.ndarray, stay: np.ndarray, forced: np.ndarray) -> np.ndarray:
    """Roles (0 user, 1 assistant) of the best segmentation of one chain of lines.

    ``diff`` speaks for the user, ``bound[i]`` for line i and i - 1 being of one turn, ``stay[k]`` for going on after
    k + 1 lines; ``forced`` is -1 or the role of a line. Exact, in one pass: of a turn only its role and its length, up
    to the longest that ``stay`` tells apart, matter for what follows.
    """
    n, k = len(diff), len(stay)
    half, bounds, must, low = (diff / 2).tolist(), bound.tolist(), forced.tolist(), float("-inf")
    hold = stay.tolist()
    best = [[low] * k, [low] * k]
    for y in (0, 1):
        if must[0] in (-1, y):
            best[y][0] = half[0] if y == 0 else -half[0]
    back = []
    for i in range(1, n):
        new, came = [[low] * k, [low] * k], [[0] * k, [0] * k]
        for y in (0, 1):
            if must[i] not in (-1, y):
                continue
            mine, other, b, l = best[y], best[1 - y], bounds[i], half[i] if y == 0 else -half[i]
            a = max(range(k), key=other.__getitem__)
            new[y][0], came[y][0] = other[a] + l, a
            for a in range(k):
                to, value = min(a + 1, k - 1), mine[a] + b + hold[a] + l
                if a == k - 1 == 0:  # one length only: going on and beginning share a state
                    if value > new[y][0]:
                        new[y][0], came[y][0] = value, -1
                elif value > new[y][to] or a == 0:
                    new[y][to], came[y][to] = value, a
        best = new
        back.append(came)
    y, a = max(((y, a) for y in (0, 1) for a in range(k)), key=lambda s: best[s[0]][s[1]])
    out = [y]
    for came in reversed(back):
        before = came[y][a]
        if k == 1:
            y = y if before == -1 else 1 - y
        elif a == 0:
            y, a = 1 - y, before
        else:
            a = before
        out.append(y)
    return np.array(out[::-1])


ITEM = "session_id string, line_id bigint, t double, listed int, close double, words int, opener boolean, ended boolean, acknowledges boolean, sure boolean, starts boolean, clean string"
TURN = "session_id string, role int, line_id bigint, n_lines bigint, t double, t_end double, clean string"
_ITEMS = [c.split()[0] for c in ITEM.split(", ")]
_LEVEL = TURN + ", listed int, close double, words int, opener boolean, ended boolean, acknowledges boolean, sure boolean, starts boolean, settled boolean"


def _segment(lines: pd.DataFrame, opens: np.ndarray, weights: np.ndarray, last: bool) -> pd.DataFrame:
    """Turns of sorted lines of whole groups, and the lines that only a larger group can tell (none if ``last``)."""
    n = len(lines)
    listed, near = lines["listed"].to_numpy(float), lines["close"].to_numpy(float)
    f = features(lines["t"], lines["words"], lines["ended"], lines["opener"], lines["acknowledges"])
    diff, bound, stay = weights[0] * listed + weights[1] * near, f @ weights[2:-AGES], weights[-AGES:]
    starts = lines["starts"].to_numpy(bool)  # a turn is known to begin here; what stood before it may be gone
    loose = float(np.abs(weights[2:-AGES]) @ np.array(list(BOUNDARY.values())))
    before = np.where(opens | starts, loose, np.abs(bound))
    after = np.append(before[1:], loose)
    # turning one line's role changes two boundaries, and the lengths behind it at no more than AGES boundaries
    against = before + after + 2 * np.abs(stay).max() + AGES * (stay.max() - stay.min())
    sure = lines["sure"].to_numpy(bool) | (np.abs(diff) > against)
    want = np.where(diff > 0, 0, 1)
    starts = starts.copy()
    starts[1:] |= sure[1:] & sure[:-1] & (want[1:] != want[:-1]) & ~opens[1:]
    group = np.cumsum(opens) - 1
    chain = np.cumsum(opens | starts) - 1  # decoded apart from each other
    heads = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    role = np.where(sure, want, -1)
    held = np.zeros(len(heads), bool)  # chains that a larger group decides: the first and the last of each group
    if not last:
        g = group[heads]
        held = np.concatenate([[True], g[1:] != g[:-1]]) | np.concatenate([g[1:] != g[:-1], [True]])
        held &= ~(np.concatenate([g[1:] == g[:-1], [False]]) & starts[heads])  # it begins for certain and another one follows
    ends = np.append(heads[1:], n)
    open_ = np.add.reduceat((role < 0).astype(int), heads) > 0
    for c in np.flatnonzero(open_ & ~held):
        a, b = heads[c], ends[c]
        if (diff[a:b] != 0).any():  # without any evidence nothing tells the roles apart
            role[a:b] = decode(diff[a:b], bound[a:b], stay, role[a:b])
    keep = held[chain]
    texts = lines["clean"]
    new = np.concatenate([[True], (role[1:] != role[:-1]) | (chain[1:] != chain[:-1])]) | (role < 0)
    done = np.flatnonzero(new & ~keep & (role >= 0))
    stop = np.flatnonzero(np.concatenate([new[1:], [True]]) & ~keep & (role >= 0))
    out = {"session_id": lines["session_id"].to_numpy()[done], "role": role[done], "line_id": lines["line_id"].to_numpy()[done], "n_lines": stop - done + 1, "t": lines["t"].to_numpy()[done], "t_end": lines["t"].to_numpy()[stop]}
    if texts.notna().any():
        said = texts.tolist()
        out["clean"] = [" ".join(said[a : b + 1]) for a, b in zip(done, stop, strict=True)]
    turns = pd.DataFrame(out).assign(settled=True)
    if last or not keep.any():
        return turns
    rest = lines[keep].assign(sure=sure[keep], starts=starts[keep], settled=False)
    return pd.concat([turns, rest], ignore_index=True)


def _shape(frame: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    frame = frame.reindex(columns=columns)
    for c in ("session_id", "clean"):
        frame[c] = frame[c].astype(object)
    for c in ("role", "n_lines", "listed", "words"):
        if c in columns:
            frame[c] = frame[c].astype("Int64")
    for c in ("opener", "ended", "acknowledges", "sure", "starts"):
        if c in columns:
            frame[c] = frame[c].astype("boolean")
    return frame


def _by_group(keys: list[str], work, columns: list[str]):
    """Runs ``work(lines, opens)`` on whole groups of a sorted stream; the last group of a batch waits, unjoined, for its end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        name = None
        for frame in frames:
            if not len(frame):
                continue
            here = frame[keys]
            opens = (here != here.shift()).any(axis=1).to_numpy()
            opens[0] = name is None or tuple(here.iloc[0]) != name
            at = np.flatnonzero(opens)
            if len(at):
                ready = pd.concat([*waiting, frame.iloc[: at[-1]]], ignore_index=True)
                if len(ready):
                    yield _shape(work(*_once(ready, keys)), columns)
                waiting = []
            waiting.append(frame.iloc[at[-1] if len(at) else 0 :])
            name = tuple(here.iloc[-1])
        if waiting:
            yield _shape(work(*_once(pd.concat(waiting, ignore_index=True), keys)), columns)

    return run


def _once(lines: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """Lines without redelivered ones (they are neighbours), and where groups begin."""
    opens = (lines[keys] != lines[keys].shift()).any(axis=1).to_numpy()
    ids, t = lines["line_id"].to_numpy(), lines["t"].to_numpy()
    keep = opens.copy()
    keep[1:] |= (ids[1:] != ids[:-1]) | (t[1:] != t[:-1])
    return (lines, opens) if keep.all() else (lines[keep].reset_index(drop=True), opens[keep])


def fit(lines: DataFrame, sample_rows: int = 4_000, slot_s: float = 600.0, hidden: float = 0.2, misspelt: float = 0.15) -> np.ndarray:
    """Weights from at most ``sample_rows`` lines with a listed label, in the order of a hash of session and piece of time.

    Of their labels a part is hidden and a part replaced by a misspelt name, so that pauses, words, lengths and names that
    are only close get weights of their own.
    """
    known = lines.where("listed <> 0").withColumn("slot", F.floor(F.col("t") / slot_s)).drop("clean")
    sample = known.orderBy(F.xxhash64("session_id", "slot"), "session_id", "slot", "t", "line_id").limit(sample_rows).toPandas()
    rng = np.random.default_rng(5)
    closes: dict[int, list[float]] = {1: [], -1: []}
    for sign, names in ((1, USER_LABELS), (-1, ASSISTANT_LABELS)):
        for name in (x for x in names if len(x) >= SHORT):
            for i in range(len(name) - 1):
                for wrong in (name[:i] + name[i + 1 :], name[:i] + name[i + 1] + name[i] + name[i + 2 :]):
                    e = evidence(wrong)
                    if not e[0]:
                        closes[sign].append(e[1])
    sequences = []
    for _, s in sample.groupby(["session_id", "slot"], sort=True):
        s = s[(s["line_id"] != s["line_id"].shift()) | (s["t"] != s["t"].shift())]
        role = np.where(s["listed"].to_numpy() > 0, 0, 1)
        f = features(s["t"], s["words"], s["ended"], s["opener"], s["acknowledges"])
        u = rng.random(len(s))
        e = np.stack([np.where(role == 0, 1.0, -1.0), np.zeros(len(s))], 1)
        e[u < hidden + misspelt, 0] = 0
        for i in np.flatnonzero((u >= hidden) & (u < hidden + misspelt)):
            e[i, 1] = rng.choice(closes[1 if role[i] == 0 else -1])
        sequences += [(e[i : i + 64], f[i : i + 64], role[i : i + 64]) for i in range(0, len(s), 64)]
    return train(sequences)


def speaker_turns(lines: DataFrame, with_text: bool = True, slot_s: float = 600.0, widen: int = 64, sample_rows: int = 4_000, weights: np.ndarray | None = None) -> DataFrame:
    """Clean turns of user and assistant in time order.

    ``lines`` as in ``read_lines``. Turns are those of the best segmentation under ``weights`` (fitted if not given) of
    the lines with speech, in the order of time and line id within a session. Lines without speech, without a session,
    an id or any time are left out and interrupt nothing; a session without a single label that says anything gives no
    turns; repeated lines count once. Pieces are ``slot_s`` seconds, then ``widen`` times that, then whole sessions.
    Result: session_id, turn_speaker, opening_line_id, n_lines, start_s, end_s (start of the last line), text (null if
    not asked for). No lines give no rows.
    """
    parsed = read_lines(lines).where("words > 0 and session_id is not null and t is not null and line_id is not null")
    parsed = spill(parsed if with_text else parsed.withColumn("clean", F.lit(None).cast("string")), "lines")
    w = fit(parsed, sample_rows, slot_s) if weights is None else weights
    left = parsed.withColumn("sure", F.lit(False)).withColumn("starts", F.lit(False)).select(*_ITEMS)
    done: list[DataFrame] = []
    columns = [c.split()[0] for c in _LEVEL.split(", ")]
    for size in (slot_s, slot_s * widen):
        keys = ["session_id", "slot"]
        lined = left.withColumn("slot", F.floor(F.col("t") / size)).repartition(*keys).sortWithinPartitions(*keys, "t", "line_id")
        level = spill(lined.mapInPandas(_by_group(keys, lambda x, o: _segment(x, o, w, False), columns), _LEVEL), "level")
        done.append(level.where("settled").select(*[c.split()[0] for c in TURN.split(", ")]))
        left = level.where("not settled").select(*_ITEMS)
    lined = left.repartition("session_id").sortWithinPartitions("session_id", "t", "line_id")
    done.append(lined.mapInPandas(_by_group(["session_id"], lambda x, o: _segment(x, o, w, True), [c.split()[0] for c in TURN.split(", ")]), TURN))
    turns = done[0].unionByName(done[1]).unionByName(done[2])
    speaker = F.when(F.col("role") == 0, "user").otherwise("assistant")
    return turns.select("session_id", speaker.alias("turn_speaker"), F.col("line_id").alias("opening_line_id"), "n_lines", F.col("t").alias("start_s"), F.col("t_end").alias("end_s"), F.col("clean").alias("text"))


def sessions_without_role(lines: DataFrame) -> DataFrame:
    """Sessions that ``speaker_turns`` gives no turns because no line's label says anything: session_id, n_lines with speech."""
    said = read_lines(lines).where("words > 0 and session_id is not null and t is not null and line_id is not null")
    g = said.groupBy("session_id").agg(F.count_distinct("line_id", "t").alias("n_lines"), F.max(F.greatest(F.abs("listed"), F.abs("close"))).alias("_best"))
    return g.where("_best = 0").drop("_best")
