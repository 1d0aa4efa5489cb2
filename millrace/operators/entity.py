"""Matching names to a reference list: phrases in texts, containment, and best scores.

A reference list is collected in blocks of at most BLOCK names, whose size is thus proven before it is
broadcast; a longer list makes more blocks, and each is met by all values in turn (a stated list against
all rows). Values are made distinct first. Texts are scanned once, by a trie of words.

Defined cases: null and blank values and names match nothing; ties go to the name that is first by ordinal.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.fuzzy import SCORES

BLOCK = 20_000
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def blocks(reference: DataFrame, columns: list[str], size: int = BLOCK) -> list[list[tuple]]:
    """The reference list in blocks of about `size` rows, one brought to the driver at a time."""
    n = reference.count()
    parts = max(1, -(-n // size))
    if parts == 1:
        return [[tuple(r) for r in reference.select(*columns).collect()]] if n else []
    return [[tuple(r) for r in reference.where(F.pmod(F.xxhash64(*columns), F.lit(parts)) == i).select(*columns).collect()] for i in range(parts)]


def _trie(names: list[tuple[str, int]]) -> dict:
    root: dict = {}
    for name, at in names:
        node = root
        for w in name.split():
            node = node.setdefault(w, {})
        node.setdefault(None, []).append(at)
    return root


def phrases(texts: DataFrame, id_col: str, text_col: str, reference: DataFrame, name: str = "name", ident: str = "ident") -> DataFrame:
    """(id, name, ident): every name of the list that stands in a text as a whole phrase, once a text.

    Texts and names must be normal forms (words with single blanks). A text is scanned once whatever the length of the list.
    """
    out = None
    schema = f"`{id_col}` long, name string, ident string"
    for part in blocks(reference.where(F.col(name).rlike(r"\S")), [name, ident]):
        shared = texts.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            root = _trie([(r[0], i) for i, r in enumerate(rows)])
            for b in batches:
                ids, got = [], []
                for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = (text or "").split()
                    hits: set[int] = set()
                    for i in range(len(words)):
                        node, j = root, i
                        while j < len(words) and (node := node.get(words[j])) is not None:
                            hits.update(node.get(None, ()))
                            j += 1
                    for h in sorted(hits):
                        ids.append(n)
                        got.append(h)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([rows[h][0] for h in got], pa.string()), pa.array([str(rows[h][1]) for h in got], pa.string())], names=[id_col, "name", "ident"])

        one = texts.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)


def longest_overlap(values: DataFrame, value: str, reference: DataFrame, name: str = "name", ident: str = "ident") -> DataFrame:
    """(value, name, ident): for each distinct value the longest name that it holds or that holds it, as normal forms."""
    out = None
    schema = "value string, name string, ident string, at long"
    distinct = values.where(F.col(value).rlike(r"\S")).select(F.col(value).alias("value")).distinct()
    for part in blocks(reference.where(F.col(name).rlike(r"\S")), [name, ident]):
        shared = distinct.sparkSession.sparkContext.broadcast(sorted(part, key=lambda r: (-len(r[0]), r[0], str(r[1]))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            for b in batches:
                said, got = [], []
                for v in b.column(0).to_pylist():
                    hit = next((i for i, r in enumerate(rows) if r[0] in v or v in r[0]), None)
                    if hit is not None:
                        said.append(v)
                        got.append(hit)
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array([rows[h][0] for h in got], pa.string()), pa.array([str(rows[h][1]) for h in got], pa.string()), pa.array([len(rows[h][0]) for h in got], pa.int64())], names=["value", "name", "ident", "at"])

        one = distinct.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return distinct.sparkSession.createDataFrame([], "value string, name string, ident string")
    # one row a value and block: the longest of all blocks stays
    return out.groupBy("value").agg(F.min_by(F.struct("name", "ident"), F.struct(-F.col("at"), "name", "ident")).alias("r")).select("value", "r.*")


class Bounded:
    """Best score of a value among names, skipping names whose shared letters and words cannot reach the best so far."""

    def __init__(self, names: list[str], score: str, least: float = 0.0):
        self.names, self.score, self.least = names, SCORES[score], least
        self.counts = np.array([[Counter(n)[c] for c in LETTERS] for n in names], np.int16).reshape(len(names), len(LETTERS))
        self.odd = np.array([sum(v for c, v in Counter(n).items() if c not in LETTERS) for n in names], np.int16)
        self.lens = np.array([len(n) for n in names], np.int32)
        self.plain = score in ("ratio", "token_sort")
        if not self.plain:
            self.sets = np.array([len(" ".join(set(n.split()))) for n in names], np.int32)
            self.at: dict[str, list[int]] = {}  # places of each word
            for i, n in enumerate(names):
                for w in set(n.split()):
                    self.at.setdefault(w, []).append(i)

    def bounds(self, value: str) -> np.ndarray:
        """No name scores more than its bound: a common subsequence is no longer than the letters both have."""
        c = Counter(value)
        mine = np.array([c[x] for x in LETTERS], np.int16)
        odd = sum(v for x, v in c.items() if x not in LETTERS)
        both = np.minimum(self.counts, mine).sum(1) + np.minimum(self.odd, odd)
        whole = 200.0 * both / np.maximum(1, self.lens + len(value))
        if self.plain:
            return whole
        short, long = np.minimum(self.lens, len(value)), np.maximum(self.lens, len(value))
        apart = long / np.maximum(1, short)
        scale = np.where(apart < 1.5, 0.0, np.where(apart < 8, 0.9, 0.6))
        part = np.minimum(100.0, 200.0 * np.minimum(both, short) / np.maximum(1, short + np.minimum(both, short)))
        words = len(" ".join(set(value.split())))
        bound = np.maximum(whole, np.maximum(0.95 * np.minimum(100.0, 200.0 * both / np.maximum(1, self.sets + words)), scale * part))
        # words in common: the ratio on words is that of the common ones to the shorter side at most
        common = np.zeros(len(self.names), np.float64)
        for w in set(value.split()):
            common[self.at.get(w, [])] += len(w) + 1
        on = common > 0
        common = np.maximum(common - 1, 0)
        near = 0.95 * np.minimum(100.0, 200.0 * common / np.maximum(1.0, common + np.minimum(self.sets, words)))
        return np.where(on, np.maximum(bound, np.where(scale > 0, 0.95 * scale * 100, near)), bound)

    def best(self, value: str) -> tuple[float, int]:
        """(score, number) of the first best name that reaches the least score; (-1, -1) without one."""
        if not self.names:
            return -1.0, -1
        bound = self.bounds(value)
        top, at = -1.0, -1
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < max(top, self.least) - 1e-6:
                break
            if bound[k] <= top and k > at:
                continue  # it could only tie, and comes later
            s = self.score(value, self.names[k])
            if s >= self.least and (s > top or s == top and k < at):
                top, at = s, int(k)
        return top, at


def best_match(values: DataFrame, value: str, reference: DataFrame, name: str, ident: str, ordinal: str, score: str = "token_sort", within: str | None = None, least: float = 0.0) -> DataFrame:
    """(within, value, name, ident, score): the best-scoring name for each distinct value, however low it scores; from `least` on, if one is named.

    within: column of both tables; a value then meets only names of its group. The names go to the workers by
    block and are looked up by group there, so a hot group is no hot task.
    """
    group = [within] if within else []
    distinct = values.where(F.col(value).rlike(r"\S")).select(*[F.col(g).alias("grp") for g in group] or [F.lit("").alias("grp")], F.col(value).alias("value")).distinct()
    schema = "grp string, value string, name string, ident string, score double, at long"
    out = None
    ref = reference.where(F.col(name).rlike(r"\S")).select(*[F.col(g).alias("grp") for g in group] or [F.lit("").alias("grp")], F.col(name).alias("name"), F.col(ident).cast("string").alias("ident"), F.col(ordinal).cast("long").alias("at"))
    for part in blocks(ref, ["grp", "name", "ident", "at"]):
        shared = distinct.sparkSession.sparkContext.broadcast(sorted(part, key=lambda r: (str(r[0]), r[3], r[1])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by: dict[str, list[tuple]] = {}
            for r in shared.value:
                by.setdefault(r[0], []).append(r)
            finders: dict[str, Bounded] = {}
            for b in batches:
                out = []
                for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if g in by:
                        f = finders.get(g) or finders.setdefault(g, Bounded([r[1] for r in by[g]], score, least))
                        s, k = f.best(v)
                        if k >= 0:
                            out.append((g, v, by[g][k][1], by[g][k][2], s, by[g][k][3]))
                cols = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.float64(), pa.int64()])], names=["grp", "value", "name", "ident", "score", "at"])

        # values are few bytes and dear to score: they are spread by count, not by size
        n = max(distinct.sparkSession.sparkContext.defaultParallelism * 2, 8)
        one = distinct.repartition(n, "grp", "value").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = distinct.sparkSession.createDataFrame([], schema)
    best = out.groupBy("grp", "value").agg(F.max_by(F.struct("name", "ident", "score"), F.struct("score", -F.col("at"))).alias("r")).select("grp", "value", "r.*")
    return best.withColumnRenamed("grp", within) if within else best.drop("grp")


def status(matched: DataFrame, value: str, score: str = "score", cutoff: float = 90.0) -> DataFrame:
    """`matched` with match_status: NULL, EMPTY, MATCHED or UNMATCHED."""
    v = F.col(value)
    s = F.when(v.isNull(), "NULL").when(~v.rlike(r"\S"), "EMPTY").when(F.round(score) >= cutoff, "MATCHED").otherwise("UNMATCHED")
    return matched.withColumn("match_status", s)
