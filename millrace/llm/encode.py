"""Token ids of a public byte-level BPE vocabulary, by linear-time backtracking.

A text is cut into words by the vocabulary's public pattern. The bytes of a word, read as Latin-1, run
once through an Aho-Corasick automaton of all tokens, which yields the tokens at every position. The
encoder takes the longest at each place and goes back to shorter ones as long as neighbours are not
compatible; two neighbours are compatible if merging their bytes by the ranks leaves exactly these two.
Compatibility is memoised by pair and whole words by their text, so frequent words cost one lookup.

Defined cases: an empty and a null text give an empty list; strings that look like special tokens are
ordinary text; surrogates and other characters UTF-8 cannot hold become '?'.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# fixed value: the public pattern of the vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 300_000  # bound of the memos of a worker; a full one starts anew


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in set(own)):
        out[chr(256 + k)] = b
    return out


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, about a megabyte whatever the corpus; it goes to the workers as a broadcast."""
    return Path(path).read_bytes()


class Encoder:
    """Encodes words with the merges of a byte-level BPE vocabulary file."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)["model"]
        letters = byte_letters()
        as_latin = lambda t: "".join(chr(letters[c]) for c in t)
        vocab = {as_latin(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = (as_latin(x) for x in (m.split(" ") if isinstance(m, str) else m))
            left, right, whole = vocab[a], vocab[b], vocab.get(a + b)
            if whole is None or (left, right) in self.merged:
                continue
            self.merged[left, right] = whole
            if whole not in self.halves:
                self.halves[whole] = (left, right)
                self.rank[whole] = r
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if len(t) == 1 or i in self.halves:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.word_memo: dict[str, list[int]] = {}
        self.words = regex.compile(PATTERN).findall

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens, encoded together, come out as just these two."""
        known = self.pair_memo.get((left, right))
        if known is None:
            if len(self.pair_memo) > MEMO:
                self.pair_memo.clear()
            known = self.pair_memo[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # The merges of both tokens are undone from the latest on, always looking at the two parts that
        # meet at the seam. If those could merge earlier than the last undone merge, the seam would not hold.
        rank, halves, merged = self.rank, self.halves, self.merged
        before = 1 << 60
        while True:
            whole = merged.get((left, right))
            if whole is not None and rank[whole] < before:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # of equal merges the one further left happens first, so the right one is undone first
            if a > b:
                before, left = a, halves[left][1]
            else:
                before, right = b + 1, halves[right][0]
                # a seam merge of equal rank lies further left than the right token's own merge

    def encode_word(self, word: str) -> list[int]:
        known = self.word_memo.get(word)
        if known is None:
            if len(self.word_memo) > MEMO:
                self.word_memo.clear()
            known = self._encode_word(word.encode("utf-8", "replace").decode("latin-1"))
            if len(word) < 64:
                self.word_memo[word] = known
        return known

    def _encode_word(self, word: str) -> list[int]:
        n = len(word)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # tokens that begin at each place, longest last
        for end, (i, size) in self.automaton.iter(word):
            at[end - size + 1].append((i, size))
        dead = bytearray(n + 1)  # places from which the rest was tried in vain
        out: list[int] = []
        trail: list[tuple[int, int]] = []  # (place, next choice there)
        place, choice = 0, len(at[0]) - 1 if n else -1
        while place < n:
            took = False
            while choice >= 0:
                i, size = at[place][choice]
                choice -= 1
                if not dead[place + size] and (not out or self.compatible(out[-1], i)):
                    out.append(i)
                    trail.append((place, choice))
                    place += size
                    choice = len(at[place]) - 1 if place < n else -1
                    took = True
                    break
            if not took:
                dead[place] = 1
                out.pop()
                place, choice = trail.pop()
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.word_memo, []
        for w in self.words(text):
            got = memo.get(w)
            out += self.encode_word(w) if got is None else got
        return out


_made: dict[int, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The encoder of a vocabulary file, built once in each worker."""
    key = hash(raw)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(raw)
    return _made[key]


def token_ids(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text."""
    vocab = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, kept columns): the size of every text in tokens."""
    vocab = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kept = [c for c in keep if c != id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for b in batches:
            n = [len(enc.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(b.column(2 + k) for k in range(len(kept)))], names=[id_col, "n_tokens", *kept])

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{id_col}` long", "n_tokens long", *(f"`{c}` {kinds[c]}" for c in kept)])
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("#text"), *kept).mapInArrow(run, schema)
