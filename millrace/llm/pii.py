"""Personal information in free text: a linear-chain conditional random field over word shapes.

The field is trained by gradient ascent on the log-likelihood of a small labelled table (forward and
backward sums in numpy) and decoded by Viterbi in numpy batches. Its features are the word, its shape
and its ending at each place of a window, so a word's part in every feature is looked up once per
distinct word and the score of a position is a sum of table rows. Addresses of mail are words and marks like any
others: what is personal and what is the mailbox of an office is learnt. Pieces are then checked exactly by form:
toll-free lines and malformed pieces are dropped, and a piece ends where its form ends.

Defined cases: null and empty texts have no pieces and come out of redaction as they are; texts and lines of any
length are decoded whole; the same piece in one text counts once; other parts of the text are left untouched; a
piece lies within one line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import labelled_pii

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
L = len(LABELS)
WINDOW = range(-5, 6)
MARK = r"\s?(?:@|[\[(]at[\])])\s?"
MAIL = re.compile(rf"(?:[\w.+-]+{MARK}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+|\s?[\[(]dot[\])]\s?[A-Za-z0-9-]+)+|[\w.+-]+\sat\s[A-Za-z0-9-]+(?:\sdot\s[A-Za-z0-9-]+)+)", re.IGNORECASE)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[^\w\s]|_")
GRID = 96_000  # words decoded together
MEMO = 200_000


def features(word: str) -> list[str]:
    """What a word says wherever it stands: itself, its shape and its ending."""
    if word.isdigit():
        return [f"d{min(len(word), 10)}", f"d{min(len(word), 10)}:{word[0]}", "digits", *([f"={word}"] if len(word) < 4 else [])]
    if not word[0].isalpha():
        return [f"={word}", "mark"]
    shape = "X" if len(word) == 1 and word.isupper() else "XX" if word.isupper() else "Xx" if word[0].isupper() else "x"
    low = word.lower()
    out = [f"={low}", f"s{shape}", f"s{shape}{min(len(word), 4)}"]
    if len(word) > 4:
        out += [f"e{low[-4:]}", f"e{low[-3:]}", f"b{low[:3]}"]
    return out


def known(word: str, index: dict[str, int]) -> list[int]:
    """Numbers of the features of a word; one that training did not get to know is marked as rare, by its shape."""
    own = features(word)
    got = [index[f] for f in own if f in index]
    if word[0].isalpha() and own[0] not in index:
        got.append(index[f"?{own[1]}"])
    return got


class Field:
    """Weights of the field: one row per (offset, feature), and the transitions."""

    def __init__(self, index: dict[str, int], w: np.ndarray, trans: np.ndarray):
        self.index, self.w, self.trans = index, w, trans
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, len(WINDOW), L), np.float32)

    def __reduce__(self):
        return Field, (self.index, self.w, self.trans)

    def row(self, word: str) -> int:
        """Number of the table row of a word; row 0 stands for no word."""
        i = len(self.ids) + 1
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        at = known(word, self.index)
        if at:
            self.rows[i] = self.w[:, at].sum(1)
        self.ids[word] = i
        return i

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(batch, time, label) scores of the words with the given row numbers, (batch, time)."""
        b, t = ids.shape
        pad = max(-WINDOW.start, WINDOW.stop - 1)
        wide = np.zeros((b, t + 2 * pad), np.int64)
        wide[:, pad : pad + t] = ids
        out = np.zeros((b, t, L), np.float32)
        for k, o in enumerate(WINDOW):
            out += self.rows[:, k][wide[:, pad + o : pad + o + t]]
        return out


def viterbi(e: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels (batch, time) of the emissions; past a sequence's length they mean nothing.

    The best sums are kept for every place, so that the way back is asked for the chosen labels only.
    """
    b, t, n = e.shape
    sums = np.empty((t, b, n), np.float32)
    sums[0] = e[:, 0] + START
    step = np.empty((n, b, n), np.float32)
    for i in range(1, t):
        np.add(sums[i - 1].T[:, :, None], trans[:, None, :], out=step)
        np.max(step, axis=0, out=sums[i])
        sums[i] += e[:, i]
    out = np.zeros((b, t), np.int8)
    into = np.ascontiguousarray(trans.T)
    now = np.zeros(b, np.int64)
    for i in range(t - 1, -1, -1):
        ends = lengths == i + 1
        way = sums[i] + np.where(ends[:, None], np.float32(0), into[now])
        now = np.where(lengths > i, way.argmax(1), 0)
        out[:, i] = now
    return out


def _allowed() -> np.ndarray:
    t = np.zeros((L, L))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a[1:] != b[1:]:
                    t[i, j] = -1e4
    return t


# no sequence begins inside a piece
START = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS], np.float32)


def _tagged(text: str, marks: list[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    words, tags = [], []
    for m in TOKEN.finditer(text):
        tag = "O"
        for a, b, k in marks:
            if a <= m.start() < b:
                tag = f"{'B' if m.start() == a else 'I'}-{k}"
        words.append(m[0])
        tags.append(LABELS.index(tag))
    return words, tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=2)
def train(copies: int = 22, seed: int = 5, epochs: int = 7, batch: int = 96, rate: float = 0.35, penalty: float = 1e-5, part: bool | None = None) -> Field:
    """The field, trained on the labelled table by stochastic gradient ascent; part: False leaves the held-out frames out."""
    data = [_tagged(*s) for s in labelled_pii.sentences(copies, seed, part)]
    seen: dict[str, int] = {}
    for words, _ in data:
        for w in set(words):
            for f in features(w):
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate([*sorted(f for f, n in seen.items() if n > (6 if f[0] == "=" else 2)), "?sX", "?sXX", "?sXx", "?sx"])}
    nf = len(index)
    field = Field(index, np.zeros((len(WINDOW), nf, L)), _allowed())
    g2w, g2t = np.full_like(field.w, 1e-3), np.full((L, L), 1e-3)
    coded = [([known(w, index) for w in words], np.array(tags)) for words, tags in data]
    coded.sort(key=lambda x: len(x[1]))
    rng = np.random.default_rng(seed)
    batches = [coded[i : i + batch] for i in range(0, len(coded), batch)]
    blocked = field.trans < -1e3
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            part = batches[k]
            b, t = len(part), max(len(x[1]) for x in part)
            lens = np.array([len(x[1]) for x in part])
            y = np.zeros((b, t), int)
            # (sequence, position, feature) triples of the window
            rs, ts, fs = [], [], []
            for r, (fw, tags) in enumerate(part):
                y[r, : len(tags)] = tags
                for i, f in enumerate(fw):
                    rs += [r] * len(f)
                    ts += [i] * len(f)
                    fs += f
            rs, ts, fs = np.array(rs), np.array(ts), np.array(fs)
            # features of one word stand together, and those of one number do once they are sorted
            begins = np.flatnonzero(np.r_[True, (rs[1:] != rs[:-1]) | (ts[1:] != ts[:-1])])
            order = np.argsort(fs, kind="stable")
            own, firsts = np.unique(fs[order], return_index=True)
            wr, wt = rs[begins], ts[begins]
            e = np.zeros((b, t, L))
            for o, off in enumerate(WINDOW):
                at = wt - off  # a word at offset `off` of position `at`
                ok = (at >= 0) & (at < lens[wr])
                e[wr[ok], at[ok]] += np.add.reduceat(field.w[o, fs], begins)[ok]
            mask = np.arange(t)[None] < lens[:, None]
            alpha, beta = np.zeros((b, t, L)), np.zeros((b, t, L))
            alpha[:, 0] = e[:, 0] + START
            for i in range(1, t):
                alpha[:, i] = np.where(mask[:, i, None], _lse(alpha[:, i - 1, :, None] + field.trans, 1) + e[:, i], alpha[:, i - 1])
            z = _lse(alpha[:, -1], 1)
            for i in range(t - 2, -1, -1):
                nxt = _lse(field.trans[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
                beta[:, i] = np.where(mask[:, i + 1, None], nxt, 0.0)
            gold = np.zeros((b, t, L))
            np.put_along_axis(gold, y[:, :, None], 1.0, 2)
            d = (gold - np.exp(alpha + beta - z[:, None, None])) * mask[:, :, None]
            gw = np.empty((len(WINDOW), len(own), L))
            for o, off in enumerate(WINDOW):
                at = ts - off
                ok = ((at >= 0) & (at < lens[rs]))[order]
                gw[o] = np.add.reduceat(d[rs[order], np.where(ok, at[order], 0)] * ok[:, None], firsts)
            gt = np.zeros((L, L))
            for i in range(1, t):
                live = mask[:, i]
                pair = np.exp(alpha[live, i - 1, :, None] + field.trans[None] + (e[live, i] + beta[live, i])[:, None, :] - z[live, None, None])
                np.add.at(gt, (y[live, i - 1], y[live, i]), 1.0)
                gt -= pair.sum(0)
            gw, gt = gw / b - penalty * field.w[:, own], gt / b
            gt[blocked] = 0
            g2w[:, own] += gw * gw
            g2t += gt * gt
            field.w[:, own] += rate * gw / np.sqrt(g2w[:, own])
            field.trans += rate * gt / np.sqrt(g2t)
    field.w, field.trans = field.w.astype(np.float32), field.trans.astype(np.float32)
    return field


PHONE = re.compile(r"^\+?\(?\d[\d\s().-]*\d(?:\s*(?:ext|x|extension)\.?\s*\d{1,5})?$", re.IGNORECASE)
TOLL_FREE = re.compile(r"^\+?1?[\s.(-]*8(?:00|33|44|55|66|77|88)\b")


def checked(kind: str, s: str) -> bool:
    """The exact check behind the field: whether the piece has the form of its kind."""
    if kind == "email":
        return bool(MAIL.fullmatch(s))
    if kind == "phone":
        n = sum(c.isdigit() for c in s)
        return bool(PHONE.match(s)) and (s[0] == "+" and 8 <= n <= 20 or 10 <= n <= 17) and not TOLL_FREE.match(s)
    if kind == "id_number":
        return sum(c.isdigit() for c in s) >= 6 and bool(re.fullmatch(r"[A-Za-z]{0,2}\d[\d\s.-]*\d", s))
    if kind == "street_address":
        return bool(re.match(r"(?:\d+\s+\S|P\.?\s?O\.?\s+Box\s+\d)", s, re.IGNORECASE))
    return 2 <= len(re.findall(r"[^\W\d_]+", s)) <= 5 and not any(c.isdigit() or c in "|>/•·\n" for c in s) and "  " not in s


NUMBER = re.compile(r"(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)")
EXTENSION = re.compile(r"\s*(?:ext|x|extension)\.?\s*\d{1,5}\b", re.IGNORECASE)
REST = re.compile(r"[A-Z]?\b(?:\s\d+[A-Z]?\b)?(?:,?\s*(?:#\s?\w+|(?:Unit|Apt|Suite|Apartment|Floor)\.?\s*\w+))?(?:,\s*[A-Z]\w+(?: [A-Z]\w+){0,2})?,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b")


def _begin(text: str, a: int, kind: str) -> int:
    """Start of a piece by its form: a phone number with its plus, country code and bracket, a mailbox with all of its user part."""
    if kind == "phone":
        if text[a - 1 : a] == "(" and re.match(r"\d{3}\)", text[a:]):
            a -= 1
        return a - len(re.search(r"(?:(?<!\d)\+?1[ .-]?|\+)?$", text[max(0, a - 4) : a])[0])
    if kind == "email":
        return a - len(re.search(r"[\w.+-]*$", text[max(0, a - 64) : a])[0])
    return a


def _whole(text: str, a: int, b: int, kind: str) -> int:
    """End of a piece by its form: with its extension, its further address parts, and a dot only behind an abbreviation."""
    if kind == "person_name":
        b = a + len(text[a:b].rstrip(" ,;:.()\"'-"))
        more = re.compile(r"(?:-[^\W\d_]+)+").match(text, b)
        b = more.end() if more else b
    if kind == "email":
        # the mark at the end of a sentence is no part of it, and a host that was cut short is completed
        form = MAIL.match(text, a)
        return form.end() if form and form.end() >= b - 1 else b
    if kind == "phone":
        b = a + len(text[a:b].rstrip(" ,;.-"))
        rest = NUMBER.match(text, a)
        b = rest.end() if rest else b
        more = EXTENSION.match(text, b)
        return more.end() if more else b
    if kind == "street_address":
        more = REST.match(text, b)
        if more:
            return more.end()
        dotted = re.search(r"\bAve\.?$", text[a:b], re.IGNORECASE)
        if dotted and text[b - 1] != "." and text[b : b + 1] == ".":
            return b + 1
        if not dotted and text[b - 1] == ".":
            return b - 1
    if kind == "person_name" and text[b - 1] == ".":
        return b - 1
    return b


# fixed texts: words that firms, banks and products are called by; a piece that ends in one or is led on by one is no person
CALLED = frozenset("Financial Finance Labs Pay Wallet Money Payments Capital Technologies Holdings Credit Bank Trust Company Card Account Loan Group Inc LLC Ltd Corp Savings National State Community Commercial Federal Checking Transfer Advance".split())
WORD = re.compile(r"\s+([^\W\d_]+)")


def of_firm(text: str, a: int, b: int) -> bool:
    after = WORD.match(text, b)
    return text[a:b].split()[-1].strip(".,").title() in CALLED or bool(after) and after[1] in CALLED


class Finder:
    """Finds the pieces of texts with a trained field."""

    def __init__(self, field: Field):
        self.field = field

    def pieces(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """For each text the (from, to, kind) of its pieces, in order. Each distinct line is decoded once."""
        f = self.field
        if len(f.ids) > MEMO:
            f.ids.clear()
            f.rows = np.zeros((1024, len(WINDOW), L), np.float32)
        lines: dict[str, int] = {}
        at: list[list[tuple[int, int]]] = []  # (number, start) of the lines of each text
        for text in texts:
            own, start = [], 0
            for line in text.split("\n") if text else ():
                if line and not line.isspace():
                    own.append((lines.setdefault(line, len(lines)), start))
                start += len(line) + 1
            at.append(own)
        got = self._decode(list(lines))
        return [sorted({(start + a, start + b, kind) for n, start in own for a, b, kind in got.get(n, ())}) for own in at]

    def _decode(self, lines: list[str]) -> dict[int, list[tuple[int, int, str]]]:
        f, get, row = self.field, self.field.ids.get, self.field.row
        rows = [[get(w) or row(w) for w in TOKEN.findall(s)] for s in lines]
        order = sorted((j for j in range(len(rows)) if rows[j]), key=lambda j: len(rows[j]))
        found: dict[int, list[tuple[int, int, str]]] = {}
        k = 0
        while k < len(order):
            # lines of like length together, as many as fill the grid
            n = 1
            while k + n < len(order) and n < 2048 and (n + 1) * len(rows[order[k + n]]) <= GRID:
                n += 1
            part = order[k : k + n]
            k += n
            lens = np.array([len(rows[j]) for j in part])
            grid = np.zeros((n, int(lens[-1])), np.int64)
            grid[np.arange(grid.shape[1])[None] < lens[:, None]] = np.fromiter((i for j in part for i in rows[j]), np.int64, int(lens.sum()))
            tags = viterbi(f.emissions(grid), f.trans, lens)
            for r in np.flatnonzero((tags > 0).any(1)).tolist():
                j = part[r]
                out = self._read(lines[j], [m.span() for m in TOKEN.finditer(lines[j])], tags[r, : lens[r]].tolist())
                if out:
                    found[j] = out
        return found

    @staticmethod
    def _read(text: str, spans: list[tuple[int, int]], tags: list[int]) -> list[tuple[int, int, str]]:
        i, out = 0, []
        while i < len(spans):
            t = tags[i]
            if t == 0:
                i += 1
                continue
            kind, j = LABELS[t][2:], i + 1
            # two address pieces with nothing but a comma between them are one
            while j < len(spans) and (LABELS[tags[j]] == f"I-{kind}" or kind == "street_address" and LABELS[tags[j]] == f"B-{kind}" and spans[j][0] - spans[j - 1][1] < 2):
                j += 1
            a = _begin(text, spans[i][0], kind)
            b = _whole(text, a, spans[j - 1][1], kind)
            if checked(kind, text[a:b]) and not (kind == "person_name" and of_firm(text, a, b)):
                out.append((a, b, kind))
            i = j
        return out


def find(df: DataFrame, id_col: str, text_col: str, field: Field | None = None) -> DataFrame:
    """(id, kind, pii_text): every distinct personal piece of every text, exactly as it stands there."""
    field = field or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for b in batches:
            at, kinds, said = [], [], []
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 1000):
                for i, got in enumerate(finder.pieces(texts[lo : lo + 1000])):
                    for kind, s in dict.fromkeys((k, texts[lo + i][x:y]) for x, y, k in got):
                        at.append(lo + i)
                        kinds.append(kind)
                        said.append(s)
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(said, pa.string())], names=[id_col, "kind", "pii_text"])

    rows = df.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, kind string, pii_text string")


def redact(df: DataFrame, id_col: str, text_col: str, field: Field | None = None) -> DataFrame:
    """(id, text, n_pieces): every text with its personal pieces replaced by placeholders of their kind."""
    field = field or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for b in batches:
            out, n = [], []
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 1000):
                for text, got in zip(texts[lo : lo + 1000], finder.pieces(texts[lo : lo + 1000])):
                    parts, last = [], 0
                    for x, y, kind in got:
                        if x >= last:
                            parts += [text[last:x], f"<{kind.upper()}>"]
                            last = y
                    out.append("".join([*parts, text[last:]]) if got else text)
                    n.append(len(got))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=[id_col, "text", "n_pieces"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` long, text string, n_pieces int")
