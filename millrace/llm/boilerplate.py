"""Main body of web pages: maximum-scoring regions over words weighed on labelled pages.

Words, word pairs and the build of a line score positive or negative, with weights fitted on labelled lines
(logistic regression); tags are gone from these texts, so line ends, separators and capitals stand in for
them. One linear scan then finds the contiguous regions of lines whose scores, less a price for each region, sum
to the most: the best region, and a further one only where it earns more than its price. So a line of
doubtful words is body beside body and furniture beside furniture. The price is fitted on labelled pages. A
flattened text is cut by words instead, into the stretches of body and furniture whose scores, less the costs of
the turns between them, sum to the most.

Defined cases: a null text has a null body and no lines; an empty text has an empty body; blank lines
are counted and belong to neither side; a line or flattened text without any known word goes with what is
beside it, and is body alone; texts are read whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import labelled_pages

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|#|[^\w\s]")
TURN, WORD_BIAS = (1.0, 2.0, 4.0), 0.05  # cost of a turn where a line may have ended, before a capital or number, and elsewhere
MEMO_LINES = 400_000  # bound of the per-worker memo of scored lines; a full memo starts anew


LITTLE = frozenset("the a an of to in on at for with and or when if is are be by from your you we our that this which will may can not no as it per any each up before after within".split())  # fixed value
SEPARATOR = re.compile(r"(?<=\s)[|·•›»>/-](?=\s)")
PRICES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)  # tried when the price of a region is fitted


def tokens(line: str) -> list[str]:
    """Lower-cased words, one sign for each number, and single punctuation marks; `line` has # for digits."""
    return TOKEN.findall(re.sub(r"#(?:[#.,]*#)?", "#", line.lower()))


def normal(line: str) -> str:
    return re.sub(r"\d", "#", line)


def _features(words: list[str]) -> list[str]:
    if not words:
        return []
    return [*words, f"^ {words[0]}", *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def _build(line: str, words: list[str]) -> list[str]:
    """How a line is built: its length, little words, capitals, separators, first and last sign."""
    real = [w for w in words if w[0].isalpha()]
    n, little = len(real), sum(w in LITTLE for w in real)
    big = sum(w[0].isupper() for w in re.findall(r"[^\W\d_]+", line))
    parts = len(SEPARATOR.findall(line))
    s = line.strip()
    size = 0 if n == 0 else 1 if n < 3 else 2 if n < 5 else 3 if n < 9 else 4 if n < 15 else 5
    share = 0 if not n else min(4, int(4 * big / n))
    last = s[-1] if s and not s[-1].isalnum() else "a"
    return [f"~n{size}", f"~l{min(little, 3)}", f"~n{size}l{min(little, 3)}", f"~c{share}", f"~c{share}l{min(little, 3)}", f"~s{min(parts, 3)}", f"~e{last}", f"~f{'a' if s[:1].isalnum() else s[:1]}", f"~n{size}e{last}"]


def line_features(line: str, words: list[str], built: bool) -> set[str]:
    return set(_features(words)) | set(_build(line, words)) if built else set(_features(words))


@lru_cache(maxsize=4)
def weights(built: bool = True, copies: int = 24, seed: int = 7, steps: int = 400, penalty: float = 4e-4) -> dict[str, float]:
    """Weight of each word, word pair and sign of build, positive for body; fitted by gradient descent on the labelled lines.

    built: with the build of lines; without it for flattened texts, which have no lines.
    """
    data = [(line_features(normal(s), tokens(normal(s)), built), y) for s, y in labelled_pages.lines(copies, seed)]
    seen: dict[str, int] = {}
    for f, _ in data:
        for x in f:
            seen[x] = seen.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n > 2))}
    rows = np.concatenate([np.full(len(f & names.keys()), i) for i, (f, _) in enumerate(data)])
    cols = np.concatenate([np.array([names[x] for x in sorted(f & names.keys())], int) for f, _ in data])
    y = np.array([label for _, label in data], float)
    # both sides weigh the same, however many lines each has
    even = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-6)
    for _ in range(steps):
        z = np.bincount(rows, w[cols], len(y))
        err = (1 / (1 + np.exp(-z)) - y) * even
        g = np.bincount(cols, err[rows], len(names)) / len(y) + penalty * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return Weights({x: float(w[i]) for x, i in names.items() if abs(w[i]) > 1e-3}, built)


@lru_cache(maxsize=2)
def price(seed: int = 3, pages: int = 300) -> float:
    """What a region costs: the price that tells most lines of labelled pages right, the least on ties.

    The pages are put together from lines whose patterns fit no weights, in turns of furniture and body.
    """
    rng = random.Random(seed)
    pool = {k: [s for s, y in labelled_pages.lines(6, seed, held=True) if y == k] for k in (0, 1)}
    w, made = weights(), []
    for _ in range(pages):
        kinds: list[int] = []
        k = rng.randint(0, 1)
        while len(kinds) < 24:
            kinds += [k] * rng.choice([1, 1, 2, 3] if k == 0 else [1, 2, 4, 8])
            k = 1 - k
        made.append(([line_score(normal(rng.choice(pool[k])), w) for k in kinds], kinds))
    right = []
    for p in PRICES:
        right.append(sum(sum(a == bool(k) for a, k in zip(inside(s, p), kinds)) for s, kinds in made))
    return PRICES[int(np.argmax(right))]


@lru_cache(maxsize=4)
def _near(known: frozenset[str]) -> dict[str, str]:
    """Known words of six or more letters by what is left of them when one letter is dropped."""
    out: dict[str, str] = {}
    for x in sorted(known):
        for i in range(len(x)):
            out.setdefault(x[:i] + x[i + 1 :], x)
    return out


class Weights(dict):
    """Weights by word and pair, with the one-slip repair of unknown words."""

    def __init__(self, w: dict[str, float], built: bool):
        super().__init__(w)
        self.built = built
        self.near = _near(frozenset(x for x, v in w.items() if len(x) > 5 and x.isalpha() and abs(v) > 0.1))
        self.repaired: dict[str, str] = {}

    def __reduce__(self):
        return Weights, (dict(self), self.built)

    def repair(self, word: str) -> str:
        """`word`, or the known word that one dropped, added, changed or swapped letter made it from."""
        if word in self or len(word) < 6 or not word.isalpha():
            return word
        got = self.repaired.get(word)
        if got is None:
            if len(self.repaired) > MEMO_LINES:
                self.repaired.clear()
            cuts = [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]
            got = self.repaired[word] = next((self.near[c] for c in cuts if c in self.near), next((c for c in cuts[1:] if len(c) > 5 and c in self), word))
        return got


def line_score(line: str, w: dict[str, float], bias: float = 0.0) -> float:
    """Log odds that a line with # for digits is body."""
    get, words = w.get, tokens(line)
    if isinstance(w, Weights):
        words = [w.repair(x) for x in words]
    return bias + sum(get(f, 0.0) for f in line_features(line, words, getattr(w, "built", True)))


def inside(scores: list[float], cost: float) -> list[bool]:
    """Whether each line lies in one of the contiguous regions whose scores, less `cost` a region, sum to the most.

    One scan: the best sum that ends inside a region and the best that ends outside. Ties stay as they are.
    """
    into, out = -cost, 0.0  # before the first line: a region may begin with it
    back: list[tuple[bool, bool]] = []
    for i, s in enumerate(scores):
        stay, enter = into if i else float("-inf"), out - cost
        leave = into if i else float("-inf")
        back.append((stay >= enter, leave > out))
        into, out = max(stay, enter) + s, max(out, leave)
    now, got = bool(scores) and into > out, [False] * len(scores)
    for i in range(len(scores) - 1, -1, -1):
        got[i] = now
        now = back[i][0] if now else back[i][1]
    return got


def turn_costs(text: str, spans: list[tuple[int, int]]) -> list[float]:
    """What it costs to turn between body and furniture before each word: least where a line is likely to have ended."""
    out = [0.0]
    for (a, b), (c, d) in zip(spans, spans[1:]):
        if text[b - 1] in ".?!" or text[b:c] != " " or not text[c:d][0].isalnum():
            out.append(TURN[0])
        else:
            out.append(TURN[1] if text[c].isupper() or text[c].isdigit() else TURN[2])
    return out


def flat_body(text: str, w: dict[str, float], bias: float = WORD_BIAS) -> str:
    """Body of a text without line breaks: the best cut of all its words into stretches of body and of furniture.

    A stretch has the log odds of a line, with the features of its first word, its words and its pairs; each
    word adds `bias`, so words without known weight go with the body beside them, or are body alone.
    """
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if not spans:
        return ""
    get, repair = w.get, w.repair if isinstance(w, Weights) else str
    words = [[repair(x) for x in tokens(normal(text[a:b]))] for a, b in spans]
    costs = turn_costs(text, spans)
    body = furniture = 0.0
    back: list[tuple[bool, bool]] = []  # whether the best way to (body, furniture) here comes from body
    last = ""
    for i, ws in enumerate(words):
        s = bias + sum(get(x, 0.0) for x in ws) + sum(get(f"{x} {y}", 0.0) for x, y in zip(ws, ws[1:]))
        first = get(f"^ {ws[0]}", 0.0) if ws else 0.0
        pair = get(f"{last} {ws[0]}", 0.0) if ws and last else 0.0
        stay_b, to_b = body + pair / 2, furniture - costs[i] + first / 2
        stay_f, to_f = furniture - pair / 2, body - costs[i] - first / 2
        if i == 0:
            stay_b, to_b, stay_f, to_f = first / 2, first / 2, -first / 2, -first / 2
        back.append((stay_b >= to_b, to_f > stay_f))
        body, furniture = max(stay_b, to_b) + s / 2, max(stay_f, to_f) - s / 2
        last = ws[-1] if ws else last
    inside, parts, end = body >= furniture, [], len(spans)
    for i in range(len(spans) - 1, -1, -1):
        before = back[i][0] if inside else back[i][1]
        if i == 0 or before != inside:
            if inside:
                parts.append(text[spans[i][0] : spans[end - 1][1]])
            end = i
        inside = before
    return " ".join(reversed(parts))


class Scorer:
    """Scores lines of Arrow batches; each distinct line of a batch is scored once."""

    def __init__(self, w: dict[str, float]):
        self.w, self.memo = w, {}

    def lines(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each line, score of each line, whether it is blank) for the non-null texts."""
        split = pc.split_pattern(text, "\n")
        flat, parent = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
        coded = pc.replace_substring_regex(flat, r"\d", "#").dictionary_encode()
        if len(self.memo) > MEMO_LINES:
            self.memo.clear()
        memo, w = self.memo, self.w
        known = np.empty(len(coded.dictionary))
        blank = np.zeros(len(coded.dictionary), bool)
        for i, s in enumerate(coded.dictionary.to_pylist()):
            v = memo.get(s)
            if v is None:
                v = memo[s] = line_score(s, w)
            known[i] = v
            blank[i] = not s or s.isspace()
        at = coded.indices.to_numpy()
        return parent, known[at], blank[at]


def _outside(parent: np.ndarray, score: np.ndarray, blank: np.ndarray, cost: float) -> np.ndarray:
    """Whether each line lies outside the body of its text; blank lines do not."""
    out = ~blank
    if not len(parent):
        return out
    at = np.flatnonzero(~blank)
    s, own = score[at].tolist(), parent[at]
    ends = np.flatnonzero(np.append(own[1:] != own[:-1], True)) + 1 if len(at) else []
    body: list[bool] = []
    a = 0
    for b in ends:
        body += inside(s[a:b], cost)
        a = b
    out[at] = ~np.array(body, bool)
    return out


def outside_lines(df: DataFrame, id_col: str, text_col: str, source: str) -> DataFrame:
    """(source_table, row_id, line_no): the lines outside the body, of texts with at least one line break."""
    w, cost = weights(), price()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(w)
        for b in batches:
            parent, score, blank = scorer.lines(b.column(1))
            out = _outside(parent, score, blank, cost)
            first = np.searchsorted(parent, parent)
            line_no = np.arange(len(parent)) - first + 1
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), pa.array(parent[out], pa.int64())), pa.array(line_no[out], pa.int32())], names=["row_id", "line_no"])

    rows = df.where(F.contains(text_col, F.lit("\n"))).select(F.col(id_col).cast("long").alias("row_id"), text_col)
    return rows.mapInArrow(run, "row_id long, line_no int").select(F.lit(source).alias("source_table"), "row_id", "line_no")


def bodies(df: DataFrame, id_col: str, text_col: str, source: str) -> DataFrame:
    """(source_table, row_id, body): the main body of every text, flattened ones included."""
    w, flat, cost = weights(), weights(built=False), price()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(w)
        for b in batches:
            parent, score, blank = scorer.lines(b.column(1))
            out = _outside(parent, score, blank, cost)
            texts: list[str | None] = []
            a = 0
            for i, t in enumerate(b.column(1).to_pylist()):
                if t is None:
                    texts.append(None)
                    continue
                parts = t.split("\n")
                texts.append(flat_body(t, flat) if len(parts) == 1 else "\n".join(p for p, o in zip(parts, out[a : a + len(parts)]) if not o))
                a += len(parts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row_id", "body"])

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "row_id long, body string").select(F.lit(source).alias("source_table"), "row_id", "body")
