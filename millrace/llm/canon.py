"""Free-entered values mapped to a canonical list by a prefix-filter set-similarity join.

Values and list entries become sets of character trigrams. A slip takes at most SPAN trigrams from a set,
so the allowed slips give the overlap that two sets must have. Trigrams are ordered by global rarity over
all distinct values and entries; only the rarest ones of which two such sets must share one (the prefixes)
are joined, then length, position and overlap filters and the exact count of slips follow. Entries with
too few trigrams for such a bound are compared with every value as poor. Of the verified entries the one
with the greatest Jaccard similarity is kept, with fewest slips where several have as much. A value with capitals
inside its words is also tried with these not parted. A value whose form a list entry has is decided by that alone.

The list is a reference list: its rows are counted before they are collected (LIST_MOST), and its forms go to the
workers in blocks of at most BLOCK, each of which all distinct values meet in turn; the best of the blocks stays. A
value that many rows share is matched once, and values are spread by number, as they are small and dear.
What reaches the driver beside the list are the counts of trigrams, of which the folded alphabet has at most 38^3.

Defined cases: null and blank values are no cases; a value no entry is near enough to gets -1, as does
one that is equally near to entries of different ids; an empty list matches nothing; forms of fewer than
four letters (as 'CD') hold no slip, since a third or more of their letters would be open.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

LIST_MOST, BLOCK = 2_000_000, 50_000
SPAN = 4  # trigrams that two swapped letters are in; other slips change fewer


def plain(s: str) -> str:
    """Lower-case ASCII letters, digits and single blanks; run-together capitals are parted."""
    s = unicodedata.normalize("NFKD", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s)).lower().replace("’", "'").replace("'", "")
    return " ".join(re.sub(r"[^a-z0-9]+", " ", s.encode("ascii", "ignore").decode()).split())


def unparted(s: str) -> str:
    """`s` with the capitals inside its words made small, so that plain() does not part it there."""
    return re.sub(r"(?<=[a-z])[A-Z]+", lambda m: m[0].lower(), s)


# fixed texts: abbreviations of the words banks are named with
BANK_WORDS = {"natl": "national", "nat": "national", "sav": "savings", "svgs": "savings", "saving": "savings", "st": "state", "comml": "commercial", "coml": "commercial", "comm": "community", "cmnty": "community", "cmty": "community", "tr": "trust", "co": "company", "cos": "company", "bk": "bank", "bnk": "bank", "fed": "federal", "fedl": "federal", "bancorp": "bank"}
KIND_WORDS = frozenset("bank trust company and national state savings federal commercial community".split())


def bank_form(s: str) -> str:
    """A bank name without article, legal tails and deposit-insurance notes, its kind words written out."""
    s = re.sub(r"\bB\s?&\s?T\b", "Bank & Trust", s, flags=re.IGNORECASE)
    s = re.sub(r"[\s,(-]*\bM\w{3,6}\s+FD\w{1,3}\b\)?", " ", s, flags=re.IGNORECASE)
    s = re.sub(r"\bN\.\s?A\.?(?=\W|$)", " ", s)
    s = s.replace("&", " and ")
    words = [BANK_WORDS.get(w, w) for w in plain(s).split()]
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    while len(words) > 1 and words[-1] in ("na", "inc", "corp", "incorporated"):
        words.pop()
    if words and words[-1] == "fsb" and len(words) > 1:
        # behind a bank it is its legal tail, else it stands for the words themselves
        words = words[:-1] if _near(words[-2], "bank", 1) or words[-2] == "trust" else [*words[:-1], "federal", "savings", "bank"]
    return " ".join(words)


def core(form: str) -> str:
    """The form of a bank name without its kind words."""
    words = form.split()
    while words and words[-1] in KIND_WORDS:
        words.pop()
    return " ".join(words)


# fixed texts: short forms in product categories
CATEGORY_WORDS = {"acct": "account", "acc": "account", "accounts": "account", "xfer": "transfer", "program": "programme", "programs": "programme", "programmes": "programme", "pmt": "payment", "pymt": "payment", "svc": "service", "ins": "insurance", "mgmt": "management", "bldr": "builder", "adv": "advance", "biz": "business"}


def category_form(s: str) -> str:
    """A category without notes and suffixes, turned back at a comma, singular, short forms written out."""
    s = re.sub(r"\([^)]*\)", " ", s)
    s = re.sub(r"\s*/\s*\w+\s*$", " ", s)
    head, comma, tail = s.partition(",")
    if comma and tail.strip():
        s = f"{tail} {head}"
    words = plain(s).split()
    if len(words) > 1 and words[-1] in ("product", "products"):
        words.pop()
    words = [CATEGORY_WORDS.get(w, w) for w in words]
    if words and len(words[-1]) > 2 and words[-1].endswith("s") and not words[-1].endswith("ss"):
        words[-1] = words[-1][:-1]
    return " ".join(words)


def slips(a: str, b: str, most: int) -> int:
    """Letters dropped, added, changed or swapped between a and b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1] if row[-1] <= most else most + 1


def _near(a: str, b: str, most: int) -> bool:
    return slips(a, b, most) <= most


def trigrams(form: str) -> set[str]:
    s = f"  {form} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def allowed(form: str) -> int:
    """Slips that a value of this length may hold."""
    n = len(form)
    return 0 if n < 4 else 1 if n < 9 else 2 if n < 16 else 3


@dataclass
class Index:
    """Inverted index over the prefixes of the list entries."""

    entries: list[tuple[str, int]]
    rarity: dict[str, int]

    def __post_init__(self) -> None:
        self.sets = [self.ordered(f) for f, _ in self.entries]
        self.post: dict[str, list[tuple[int, int]]] = {}
        for n, s in enumerate(self.sets):
            for p, g in enumerate(s[: self.prefix(self.entries[n][0])]):
                self.post.setdefault(g, []).append((n, p))
        self.exact: dict[str, set[int]] = {}
        for f, i in self.entries:
            self.exact.setdefault(f, set()).add(i)
        # entries that may share no trigram with a value within the allowed slips
        self.poor = [n for n, s in enumerate(self.sets) if len(s) < self.prefix(self.entries[n][0])]

    def ordered(self, form: str) -> list[str]:
        return sorted(trigrams(form), key=lambda g: (self.rarity.get(g, 0), g))

    def prefix(self, form: str) -> int:
        """Trigrams of which one at least outlasts the allowed slips."""
        return SPAN * allowed(form) + 1

    def similar(self, form: str) -> list[tuple[float, int, int]]:
        """(Jaccard similarity, slips, entry) of all entries within the slips allowed to both forms."""
        s, own, length = self.ordered(form), allowed(form), len(form)
        n, have, seen, near = len(s), set(s), set(), []
        for p, g in enumerate(s[: self.prefix(form)]):
            for e, q in self.post.get(g, ()):
                if e in seen:
                    continue
                seen.add(e)
                f, m = self.entries[e][0], len(self.sets[e])
                most = min(own, allowed(f))
                # length and position filters: what can still be shared from here on
                if abs(length - len(f)) <= most and min(n - p, m - q) >= max(n, m) - SPAN * most:
                    near.append(e)
        if n < self.prefix(form):
            near += [e for e in self.poor if e not in seen]
        out = []
        for e in near:
            f, m = self.entries[e][0], len(self.sets[e])
            most, both = min(own, allowed(f)), len(have.intersection(self.sets[e]))
            if both >= max(n, m) - SPAN * most and (d := slips(form, f, most)) <= most:
                out.append((both / (n + m - both), d, e))
        return out

    def best(self, *forms: str) -> tuple[float, int, int]:
        """(similarity, slips, id) of the entry nearest to one of the forms; id -1 if there is none or several ids are as near."""
        exact = {i for f in forms for i in self.exact.get(f, ())}
        if exact:
            return 1.0, 0, next(iter(exact)) if len(exact) == 1 else -1
        got: dict[int, tuple[float, int]] = {}
        for form in dict.fromkeys(forms):
            for sim, d, e in self.similar(form):
                ident = self.entries[e][1]
                got[ident] = min(got.get(ident, (1.0, 99)), (-sim, d))
        if not got:
            return 0.0, 99, -1
        ranked = sorted((v, k) for k, v in got.items())
        (sim, d), ident = ranked[0]
        return -sim, d, -1 if len(ranked) > 1 and ranked[0][0] == ranked[1][0] else ident


def bank_entries(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Forms of the banks; a name without kind words stands for a bank if no other bank has it."""
    forms = {(bank_form(n), int(i)) for n, i in rows if n and n.strip() and i is not None}
    owners: dict[str, set[int]] = {}
    for f, i in forms:
        owners.setdefault(core(f), set()).add(i)
    forms |= {(c, next(iter(i))) for c, i in owners.items() if c and len(i) == 1}
    return sorted(forms)


def category_entries(rows: list[tuple[str, int, str | None]]) -> list[tuple[str, int]]:
    """Forms of the categories and of the other words for them."""
    out = set()
    for name, i, also in rows:
        for s in [name, *(also or "").split(",")]:
            if s and s.strip():
                out.add((category_form(s), int(i)))
    return sorted(out)


def match(values: DataFrame, value_col: str, entries: list[tuple[str, int]], form: Callable[[str], str]) -> DataFrame:
    """(value, canonical_id) for every distinct non-blank value."""
    # written once: they are counted, matched and joined back
    distinct = cut(values.where(F.col(value_col).rlike(r"\S")).select(F.col(value_col).alias("value")).distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for v in b.column(0).to_pylist():
                for f in {form(v), form(unparted(v))}:
                    n.update(trigrams(f))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["g", "n"])

    rarity = Counter({r.g: r.n for r in distinct.mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()})
    for f, _ in entries:
        rarity.update(trigrams(f))
    sc = distinct.sparkSession.sparkContext
    spread = distinct.repartition(max(sc.defaultParallelism * 3, 12), "value")
    schema, out = "value string, canonical_id long, sim double, slips int", None
    for at in range(0, max(1, len(entries)), BLOCK):
        index = sc.broadcast((entries[at : at + BLOCK], dict(rarity)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = Index(*index.value)
            for b in batches:
                got = [ix.best(form(v), form(unparted(v))) for v in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[2] for x in got], pa.int64()), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int32())], names=["value", "canonical_id", "sim", "slips"])

        one = spread.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    if len(entries) <= BLOCK:
        return out.select("value", "canonical_id")
    # of several blocks the nearest; two blocks with as near ones of different ids give none
    rank = F.struct("sim", -F.col("slips"))
    best = out.groupBy("value").agg(F.max(rank).alias("r"))
    tied = out.join(best.withColumnRenamed("value", "v"), (F.col("value") == F.col("v")) & (rank == F.col("r"))).groupBy("value").agg(F.count_distinct("canonical_id").alias("n"), F.max("canonical_id").alias("canonical_id"))
    return tied.select("value", F.when(F.col("n") == 1, F.col("canonical_id")).otherwise(-1).cast("long").alias("canonical_id"))


def listed(df: DataFrame, columns: list[str], most: int = LIST_MOST) -> list[tuple]:
    """The rows of a reference list, counted before they are collected; a longer table is no reference list."""
    n = df.count()
    if n > most:
        raise ValueError(f"a list of {n} rows is no reference list (at most {most})")
    return [tuple(r) for r in df.select(*columns).collect()]


def resolve(cases: DataFrame, value_col: str, entries: list[tuple[str, int]], form: Callable[[str], str], exact: list[str]) -> DataFrame:
    """`cases` with canonical_id, for every non-blank value that is not spelled exactly like a list entry."""
    known = cases.sparkSession.createDataFrame([(x,) for x in sorted(set(exact))] or [("",)], "known string")
    open_ = cases.where(F.col(value_col).rlike(r"\S")).join(F.broadcast(known), F.col(value_col) == F.col("known"), "left_anti")
    got = match(open_, value_col, entries, form)
    return open_.join(got, F.col(value_col) == F.col("value")).drop("value")
