"""Template residue and error pages: character n-gram models and likelihood-ratio windows.

Four models are fitted on labelled values: slots, filler, notices and natural text. Each position of a
text gets, for each residue class, the log ratio of its n-gram under that class and under natural text. Filler
and notices are told by their letters; slots by their build, in which all letters are one
and all digits are one, so that the name inside a slot proves nothing.
A window is a stretch over which the sum of these ratios climbs (its start is where the sum was least).
A slot or dummy value excludes a field as soon as one window is strong enough; a dummy value that is nearly the
whole of its field needs less strength; a notice excludes it only if notice windows cover most of the text,
so text that merely speaks of such things stays. All limits are fitted by cross-validation on labelled values.

Defined cases: nulls, blanks and 'nan' are no residue; texts are read whole, whatever their length;
case and digits are folded; characters outside ASCII share one class.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import labelled_residue

CLASSES = ("slot", "filler", "notice")
BITS = 18
ORDERS = (3, 5)
PAD = 2  # boundary characters before and after each text
SPAN = 12  # characters of a coverage window
GRID = {"slot": (2, 3, 4, 5, 6, 7, 8, 10, 12, 14), "filler": (9, 10, 11, 12.5, 14, 16, 18), "dummy": (4, 5, 6, 7, 8.5, 10), "whole": (0.5, 0.7, 0.8, 0.9), "notice": (4, 6, 8, 10, 12), "cover": (0.45, 0.55, 0.65, 0.75)}


def _codes() -> np.ndarray:
    lut = np.full(256, 63, np.uint32)
    lut[0] = 0
    for i in range(26):
        lut[65 + i] = lut[97 + i] = 1 + i
    lut[48:58] = 27
    for b in b" \t\r\n":
        lut[b] = 28
    for i, b in enumerate(b"{}[]<>%$#@_!?.,:;|/&()-+'\"=*"):
        lut[b] = 29 + i
    return lut


def _shapes() -> np.ndarray:
    lut = _codes()
    lut[65:91] = lut[97:123] = 1
    return lut


LUT, SHAPE = _codes(), _shapes()


def encode(texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Codes of the texts by letters and by build, each text followed and led by boundary characters, and where each begins."""
    raw = [t.encode("utf-8", "replace").replace(b"\0", b" ") for t in texts]
    gap = b"\0" * PAD
    data = np.frombuffer(gap + gap.join(raw) + gap * 2, np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.zeros(len(raw), np.int64)
    np.cumsum(sizes[:-1] + PAD, out=starts[1:])
    return {"letters": LUT[data], "build": SHAPE[data]}, starts


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each position (the last ones wrap into the boundary)."""
    n = len(codes) - max(ORDERS) + 1
    h = codes[:n].copy()
    for k in range(1, order):
        h = h * np.uint32(64) + codes[k : n + k] if order <= 5 else h
    if order * 6 > BITS:
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2654435761)
        h >>= np.uint32(32 - BITS)
    return h


DRIFT = {"slot": 0.3, "filler": 0.15, "notice": 0.0}  # taken off each position, so that long natural text does not add up
VIEW = {"slot": "build", "filler": "letters", "notice": "letters"}


@lru_cache(maxsize=8)
def tables(fold: int | None = None, seed: int = 11, smooth: float = 0.3) -> dict[str, list[np.ndarray]]:
    """Log-ratio table of each class and order: n-gram frequency in the class against natural text; without a fold if one is named."""
    by: dict[str, list[str]] = {}
    for c, t in labelled_residue.values(seed, fold):
        by.setdefault(c, []).append(t)
    coded = {c: encode(texts)[0] for c, texts in by.items()}
    count = lambda c, view, o: np.bincount(grams(coded[c][view], o), minlength=1 << BITS).astype(np.float64)
    out = {}
    for c in CLASSES:
        out[c] = []
        for o in ORDERS:
            a, b = count(c, VIEW[c], o), count("natural", VIEW[c], o)
            p, q = (a + smooth) / (a.sum() + smooth * 3e3), (b + smooth) / (b.sum() + smooth * 3e3)
            w = np.clip(np.log(p / q), -4, 4)
            w[(a + b) == 0] = -0.6  # n-grams of neither side speak weakly for natural text
            w -= DRIFT[c]
            out[c].append((w / len(ORDERS)).astype(np.float32))
    return out


def ratios(codes: dict[str, np.ndarray], t: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
    g = {v: [grams(x, o) for o in ORDERS] for v, x in codes.items()}
    return {c: sum(t[c][k][g[VIEW[c]][k]] for k in range(len(ORDERS))) for c in CLASSES}


def strongest(llr: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text the sum of its strongest window."""
    s = llr.astype(np.float64)
    first = np.maximum(starts - 0, 0)
    s[first] -= 1e5  # the sum begins anew with each text
    total = np.cumsum(s)
    climb = total - np.minimum.accumulate(total)
    return np.maximum.reduceat(climb, np.minimum(starts, len(climb) - 1)) if len(starts) else np.zeros(0)


def covered(llr: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Share of the decided windows of each text that speak for the class."""
    c = np.concatenate([[0.0], np.cumsum(llr, dtype=np.float64)])
    n = len(llr)
    lo = np.maximum(np.arange(n) - SPAN // 2, 0)
    hi = np.minimum(lo + SPAN, n)
    w = c[hi] - c[lo]
    yes = np.concatenate([[0], np.cumsum(w > 2.0)])
    no = np.concatenate([[0], np.cumsum(w < -8.0)])
    a, b = np.minimum(starts, n), np.minimum(ends, n)
    y, x = yes[b] - yes[a], no[b] - no[a]
    return y / np.maximum(1, y + x)


def scores(texts: list[str], t: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
    """Strength of the strongest window of each class, and the share that notice and filler windows cover."""
    codes, starts = encode(texts)
    llr = ratios(codes, t)
    ends = np.append(starts[1:], len(codes["letters"]) - 2 * PAD)
    out = {c: strongest(llr[c].copy(), starts, ends - starts) for c in CLASSES}
    return out | {"cover": covered(llr["notice"], starts, ends), "whole": covered(llr["filler"], starts, ends)}


def _verdicts(score: dict[str, np.ndarray], limits: dict[str, float]) -> np.ndarray:
    out = np.zeros(len(score["slot"]), int)
    out[(score["notice"] > limits["notice"]) & (score["cover"] > limits["cover"])] = 3
    out[(score["filler"] > limits["filler"]) | (score["filler"] > limits["dummy"]) & (score["whole"] > limits["whole"])] = 2
    out[score["slot"] > limits["slot"]] = 1
    return out


@lru_cache(maxsize=2)
def fitted_limits(seed: int = 23, natural: float = 3.0) -> dict[str, float]:
    """The limits that tell most labelled values right, each scored by models that its fold is held out of.

    natural: what a natural value that is taken for residue counts against a residue value that is missed. Classes are
    fitted one by one; of limits that do as well the middle one is taken.
    """
    kinds: list[str] = []
    parts: list[dict[str, np.ndarray]] = []
    for fold in range(labelled_residue.FOLDS):
        labelled = labelled_residue.values(seed, fold, held=True)
        kinds += [c for c, _ in labelled]
        parts.append(scores([t for _, t in labelled], tables(fold)))
    score, kind = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}, np.array(kinds)
    none = {"slot": 1e9, "filler": 1e9, "dummy": 1e9, "whole": 1.0, "notice": 1e9, "cover": 1.0}
    got = dict(none)
    for c, names in (("slot", ["slot"]), ("notice", ["notice", "cover"]), ("filler", ["filler", "dummy", "whole"])):
        ok = []
        for tried in itertools.product(*(GRID[n] for n in names)):
            hit = _verdicts(score, none | dict(zip(names, tried))) == CLASSES.index(c) + 1
            right = (hit & (kind == c)).sum() / (kind == c).sum() - natural * (hit & (kind == "natural")).sum() / (kind == "natural").sum()
            ok.append((round(float(right), 4), tried))
        best = [t for r, t in ok if r == max(r for r, _ in ok)]
        got |= dict(zip(names, best[len(best) // 2]))
    return got


def judge(texts: list[str], t: dict[str, list[np.ndarray]], limits: dict[str, float] | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Class number of each text (0: none, then CLASSES in order) and its scores."""
    if not texts:
        return np.zeros(0, int), {}
    score = scores(texts, t)
    return _verdicts(score, limits or fitted_limits()), score


BATCH_BYTES = 1 << 21


def unnamed(text: str, name: str | None) -> str:
    """`text` without the name of the site, which proves nothing; a text of nothing else stays."""
    if not name or len(name) < 3:
        return text
    bare = re.sub(re.escape(name), " ", text, flags=re.IGNORECASE)
    return bare if bare.strip(" -|:\n") else text


def find(df: DataFrame, id_col: str, text_cols: str | list[str], source: str, name_col: str | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """(source_table, field_name, row_id, kind): the values of some fields that are residue, with its class; the table is read once.

    name_col: column with the name of the site, which is left out of account where the text repeats it.
    """
    t, limits = tables(), limits or fitted_limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [unnamed(s, n) for s, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            at, kinds, part, size = [], [], [], 0
            for i, s in enumerate(texts):  # slices of bounded size keep the arrays small
                part.append(i)
                size += len(s)
                if size > BATCH_BYTES or i == len(texts) - 1:
                    k, _ = judge([texts[j] for j in part], t, limits)
                    hit = np.flatnonzero(k)
                    at += [part[j] for j in hit]
                    kinds += [CLASSES[k[j] - 1] for j in hit]
                    part, size = [], 0
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), took), pc.take(b.column(3), took), pa.array(kinds, pa.string())], names=["row_id", "field_name", "kind"])

    fields = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    name = (F.col(name_col) if name_col else F.lit(None)).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("text")) for c in fields]))
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), name.alias("name"), each.alias("v")).select("row_id", F.col("v.text").alias("text"), "name", F.col("v.field_name").alias("field_name"))
    rows = rows.where(F.col("text").rlike(r"\S") & (F.lower(F.trim("text")) != "nan"))
    got = rows.mapInArrow(run, "row_id long, field_name string, kind string")
    return got.select(F.lit(source).alias("source_table"), "field_name", "row_id", "kind")
