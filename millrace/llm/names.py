"""Spellings of one entity linked by noisy-channel attribution.

Distinct spellings are ranked by frequency; the more frequent ones are candidate canonical forms of the
others. A spelling and its candidates meet through their rare words: each word that few names share gives
keys (itself and itself with one letter dropped), so that a slip on either side still meets. Pairs that met by
too few words to be one entity are dropped before they are looked at. The channel then tells how a writer could have
made the spelling from the candidate: slips, abbreviations, another word order, run-together or parted
words, a legal form more or less. What each of these costs is estimated from the pairs themselves: attached at
first guesses, the rates among the attached pairs give the prices of the next round. The spelling is attached to the
candidate with the highest posterior (log frequency minus price); attachments always lead to a higher
rank and are followed to their root, however long the way. What names only the first word of a company is attached in a
second step, and only if a single root has that word; its posterior is then certain, as no other root could have
made it.

Defined cases: null and blank names take no part; names that differ in nothing but spelling keep their
own rows in the result; a word missing or added beyond legal forms and articles makes another product;
ties of the posterior go to the candidate that is first by rank, rank ties to the smaller name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.canon import slips
from millrace.session import cut

# fixed texts: articles, legal forms and fillers that do not tell names apart
STOP = frozenset("the of and a inc llc ltd corp co company limited incorporated corporation plc app gmbh sa".split())
# fixed texts: words that many names share, known from the start
SHARED = {
    "company": "financial finance group technologies technology holdings capital credit money pay payments wallet labs bank".split(),
    "product": "line credit investment account debit card rewards builder prepaid certificate deposit savings checking personal loan business money transfer cash advance plus premium student metal junior 2 3 4 gold platinum".split(),
}
# fixed texts: short forms that are not made by dropping letters
SHORT = {"biz": "business", "xfer": "transfer", "jr": "junior", "ii": "2", "tech": "technologies"}
MAY_LACK = frozenset(["card", "account"])  # type words that a product name may lack
# what a writer may do to a name, with the rates that the first round guesses
DEEDS = {"slip": 0.05, "slip_2": 0.007, "abbreviated": 0.22, "initials": 0.05, "order": 0.37, "lacking": 0.08, "joined": 0.37, "legal": 0.6}
SLIP, SLIP_2, ABBREVIATED, INITIALS, ORDER, LACKING, JOINED, LEGAL = range(len(DEEDS))
GUESS = [-math.log(r) for r in DEEDS.values()]
MOST = 11.0  # a spelling that the first guesses price higher is not attached
ROUNDS = 2  # of estimation


def words(name: str) -> list[str]:
    """Folded words of a name, run-together capitals parted, what follows a comma brought to the front unless it is a legal form."""
    s = re.sub(r"[™®©]", "", name)
    s = re.sub(r"\+\s*$", " plus", s)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s)
    head, comma, tail = s.partition(",")
    bits = lambda x: re.findall(r"[a-z0-9]+", x.lower().replace("'", "").replace("’", ""))
    front, back = bits(head), bits(tail)
    return front + back if not comma or all(w in STOP for w in back) else back + front


def abbreviates(a: str, w: str) -> bool:
    """Whether a could stand for w: its letters in order from the first on."""
    if SHORT.get(a) == w:
        return True
    if not 2 <= len(a) < len(w) or a[0] != w[0]:
        return False
    it = iter(w)
    return all(c in it for c in a)


def _same(a: str, b: str, core: bool) -> int | None:
    """The deed that makes a of b, -1 for none; None if that cannot be."""
    if a == b:
        return -1
    if not core and (abbreviates(a, b) or abbreviates(b, a)):
        return ABBREVIATED
    n = min(len(a), len(b))
    if n >= 3 and not (a.isdigit() or b.isdigit()):
        d = slips(a, b, 2 if n >= 6 else 1)
        if d == 1 and n >= 4:
            return SLIP
        # three letters with a slip, or six with two, are weak: the rest of the name must carry them
        if core and d == 1 or d == 2 and n >= 6:
            return SLIP_2
    if not core and n == 3 and slips(a, b, 1) == 1 and a[0] == b[0]:
        return SLIP
    return None


COST = [*GUESS, 0.0]  # of the deeds by number, 0 for none


def deeds(v: list[str], c: list[str], shared: frozenset[str], kind: str) -> list[int] | None:
    """How often each deed made the candidate c into v, None if v must be another entity."""
    vs, cs = [w for w in v if w not in STOP], [w for w in c if w not in STOP]
    if not vs or not cs:
        return None
    done = [0] * len(DEEDS)
    done[LEGAL] = int(sorted(w for w in v if w in STOP) != sorted(w for w in c if w in STOP))
    if vs == cs:
        return done
    left, lacking, at = list(vs), [], []
    for core in (True, False):
        for w in cs:
            if (w not in shared) != core:
                continue
            best = min(((COST[p], i, p) for i, x in enumerate(left) if x is not None and (p := _same(x, w, core)) is not None), default=None)
            if best is None:
                lacking.append(w)
            else:
                if best[2] >= 0:
                    done[best[2]] += 1
                at.append((cs.index(w), best[1]))
                left[best[1]] = None
    rest = [x for x in left if x is not None]
    # words written together or apart
    for x in list(rest):
        for i in range(len(cs) - 1):
            a, b = cs[i], cs[i + 1]
            if a in lacking and b in lacking and (x == a + b or len(x) > 7 and slips(x, a + b, 1) == 1):
                lacking.remove(a)
                lacking.remove(b)
                rest.remove(x)
                done[JOINED] += 1
                done[SLIP] += x != a + b
                break
    for w in list(lacking):
        for i in range(len(vs) - 1):
            a, b = vs[i], vs[i + 1]
            if a in rest and b in rest and (a + b == w or len(w) > 7 and slips(a + b, w, 1) == 1):
                rest.remove(a)
                rest.remove(b)
                lacking.remove(w)
                done[JOINED] += 1
                break
    # a word torn apart of which one half was taken for an abbreviation
    if rest and not lacking and "".join(sorted("".join(vs))) == "".join(sorted("".join(cs))):
        done[JOINED] += 1
        return done
    # initials of the type words
    if len(rest) == 1 and len(rest[0]) in (2, 3):
        short = [w for w in c if w in lacking or w == "of"]
        full = "".join(w[0] for w in short if w in shared or w == "of")
        if rest[0] in (full, "".join(w[0] for w in short if w in shared)):
            lacking = [w for w in lacking if w not in shared]
            rest = []
            done[INITIALS] += 1
    if rest:
        return None
    for w in lacking:
        if w not in shared or kind == "product" and w not in MAY_LACK:
            return None
        done[LACKING] += 1
    if kind == "product" and lacking and not any(w in shared and w not in lacking for w in cs):
        return None
    order = [i for _, i in sorted(at)]
    done[ORDER] = int(order != sorted(order))
    return done if sum(n * p for n, p in zip(done, GUESS)) <= MOST else None


def stands_for(v: list[str], c: list[str], shared: frozenset[str]) -> bool:
    """Whether v, which lacks the second word of a company, fits the company c."""
    vs, cs = [w for w in v if w not in STOP], [w for w in c if w not in STOP]
    core = [w for w in cs if w not in shared]
    if len(core) < 2 or len(core[1]) < 3 or not vs or _same(vs[0], core[0], True) is None:
        return False
    kinds = [w for w in cs if w in shared]
    for w in vs[1:]:
        if len(w) == 1 and core[1].startswith(w):
            continue
        if w in core[1:] or not any(_same(w, k, False) is not None for k in kinds):
            return False
    return True


def common(toks: list[str], shared: frozenset[str]) -> bool:
    """Whether a name has only shared or short words."""
    return not any(w not in STOP and w not in shared and len(w) > 2 for w in toks)


HARD = (4, 5)  # lengths at which a word meets another only through a common key: longer ones may differ by two slips


def keys(toks: list[str], shared: frozenset[str]) -> tuple[list[tuple[str, int]], int]:
    """Keys under which a spelling meets others, each with the number of the word it is of, and how many hard words there are.

    Keys are the rare words (all words, if none is rare), with and without any one letter; numbers below 0 stand for words that
    are not hard, -2 for pairs of words and the whole. A hard word of a candidate must meet for the pair to be one entity.
    """
    out: dict[str, int] = {}
    bits = [w for w in toks if w not in STOP]
    rare = [w for w in bits if w not in shared and len(w) > 2] or bits
    plain = bool([w for w in bits if w not in shared and len(w) > 2])
    if bits:
        out["=" + "".join(bits)] = -2
    for a, b in zip(rare, rare[1:]):
        out.update(dict.fromkeys([a + b, *((a + b)[:i] + (a + b)[i + 1 :] for i in range(len(a + b)))], -2))
    hard = 0
    for w in dict.fromkeys(rare):
        n = hard if plain and len(w) in HARD else -1
        hard += n >= 0
        for k in [w, *(w[:i] + w[i + 1 :] for i in range(len(w) if len(w) > 3 else 0))]:
            # a key of two words speaks for no hard one alone
            out[k] = n if out.get(k, n) == n else min(-1, out[k])
    return sorted(out.items()), hard


def tokenized(names: DataFrame) -> DataFrame:
    """(kind, name, freq, toks) of (kind, name, freq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([words(s) for s in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["kind", "name", "freq", "toks"])

    return names.mapInArrow(run, "kind string, name string, freq long, toks array<string>")


def shared_words(toks: DataFrame, share: float = 0.02, least: int = 8) -> dict[str, frozenset[str]]:
    """Words that stand behind many different first words, by kind; at most 1/share times the words of a name each.

    `share` bounds what comes to the driver: a name adds its words once for each first word, so no more
    than (words per first word) / share of them can reach the share.
    """
    first = toks.where(F.size("toks") > 1).select("kind", F.col("toks")[0].alias("first"), F.explode(F.slice("toks", F.lit(2), F.size("toks"))).alias("w")).distinct()
    many = first.groupBy("kind").agg(F.countDistinct("first").alias("n"))
    got = first.groupBy("kind", "w").agg(F.count("*").alias("k")).join(F.broadcast(many), "kind").where((F.col("k") >= least) & (F.col("k") >= F.col("n") * share)).select("kind", "w").collect()
    return {k: frozenset([*SHARED.get(k, []), *(r.w for r in got if r.kind == k)]) for k in {*SHARED, *(r.kind for r in got)}}


def _rank() -> list:
    return [F.desc("freq"), F.desc(F.length("name")), F.asc("name")]


def attribute(names: DataFrame) -> DataFrame:
    """(kind, name, root): the canonical spelling of every distinct spelling of (kind, name, freq)."""
    spark = names.sparkSession
    # written once, so that the numbers stay; pairs are met and shuffled by number
    toks = cut(tokenized(names.where(F.col("name").rlike(r"\S"))))
    toks = toks.withColumn("id", F.monotonically_increasing_id())
    shared = spark.sparkContext.broadcast(shared_words(toks))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, at, ks, ws, hard = b.column(0).to_pylist(), [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                k, h = keys(t, shared.value.get(kinds[i], frozenset()))
                at += [i] * len(k)
                ks += [x for x, _ in k]
                ws += [n for _, n in k]
                hard += [h] * len(k)
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), pa.array(at, pa.int64())), pc.take(b.column(1), pa.array(at, pa.int64())), pa.array(ks, pa.string()), pa.array(ws, pa.int32()), pa.array(hard, pa.int32())], names=["kind", "id", "key", "word", "hard"])

    thin = toks.select("kind", "id", "toks").mapInArrow(keyed, "kind string, id long, key string, word int, hard int")
    # two keys of one hash only add a pair to look at
    thin = thin.select(F.xxhash64("kind", "key").alias("h"), "id", "word", "hard")
    met_by = thin.alias("a").join(thin.alias("b"), "h").where("a.id < b.id").groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.hard").alias("hard_a"), F.col("b.hard").alias("hard_b"))
    words_of = lambda s: F.count_distinct(F.when(F.col(f"{s}.word") >= 0, F.col(f"{s}.word")))
    met_by = met_by.agg(words_of("a").alias("n_a"), words_of("b").alias("n_b"), F.least(F.min("a.word"), F.min("b.word")).alias("least"))
    # a pair that met by fewer hard words than its candidate has, and by no joined form, cannot be one entity
    joined = F.col("least") == -2
    pairs = met_by.where(joined | (F.col("n_a") >= F.col("hard_a")) | (F.col("n_b") >= F.col("hard_b")))
    pairs = pairs.select("a", "b", joined.alias("free"), (joined | (F.col("n_a") >= F.col("hard_a"))).alias("ok_a"), (joined | (F.col("n_b") >= F.col("hard_b"))).alias("ok_b"))

    # a name without rare word meets every name that has one of its words; two others do not meet so
    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, at, ws, only = b.column(0).to_pylist(), [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                bits = sorted({w for w in t if w not in STOP})
                at += [i] * len(bits)
                ws += bits
                only += [common(t, shared.value.get(kinds[i], frozenset()))] * len(bits)
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), pa.array(at, pa.int64())), pc.take(b.column(1), pa.array(at, pa.int64())), pa.array(ws, pa.string()), pa.array(only, pa.bool_())], names=["kind", "id", "w", "common"])

    by_word = toks.select("kind", "id", "toks").mapInArrow(worded, "kind string, id long, w string, common boolean")
    met = by_word.where("common").alias("g").join(by_word.alias("o"), ["kind", "w"]).where("g.id <> o.id")
    met = met.select(F.least("g.id", "o.id").alias("a"), F.greatest("g.id", "o.id").alias("b"), F.lit(True).alias("free"), F.lit(True).alias("ok_a"), F.lit(True).alias("ok_b"))
    pairs = pairs.unionByName(met).groupBy("a", "b").agg(F.bool_or("free").alias("free"), F.bool_or("ok_a").alias("ok_a"), F.bool_or("ok_b").alias("ok_b"))
    # words that are not shared must all be met by one within two slips, which no more than four plain edits are
    unshared = {k: sorted(v) for k, v in shared.value.items()}
    told = F.coalesce(*[F.when(F.col("kind") == k, F.array(*[F.lit(w) for w in v]).cast("array<string>")) for k, v in unshared.items()], F.array().cast("array<string>"))
    stop = F.array(*[F.lit(w) for w in sorted(STOP)])
    cores = toks.withColumn("core", F.array_except(F.array_except("toks", told), stop))
    side = lambda s: cores.select(F.col("id").alias(s), "kind" if s == "a" else F.col("kind").alias("kind_b"), F.struct("freq", F.length("name").alias("n"), "name", "toks", "core").alias(f"t_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # the lower rank is the variant: less frequent, shorter, later by name
    x, y = F.col("t_a"), F.col("t_b")
    a_low = (x["freq"] < y["freq"]) | ((x["freq"] == y["freq"]) & ((x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["name"] > y["name"]))))
    v, c = F.when(a_low, x).otherwise(y), F.when(a_low, y).otherwise(x)
    kept = both.where((F.col("kind") == F.col("kind_b")) & F.when(a_low, F.col("ok_b")).otherwise(F.col("ok_a")))
    near = F.forall(c["core"], lambda w: F.exists(v["toks"], lambda x: F.levenshtein(x, w, 4) >= 0))
    kept = kept.where(F.col("free") | near)
    full = kept.select("kind", v["name"].alias("name"), c["name"].alias("cand"), c["freq"].alias("cfreq"), v["toks"].alias("toks"), c["toks"].alias("ctoks"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = {n: b.column(n).to_pylist() for n in ("kind", "toks", "ctoks")}
            got = [deeds(v, c, shared.value.get(k, frozenset()), k) for k, v, c in zip(d["kind"], d["toks"], d["ctoks"])]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("name"), b.column("cand"), b.column("cfreq"), pa.array(got, pa.list_(pa.int32()))], names=["kind", "name", "cand", "cfreq", "done"])

    could = cut(full.mapInArrow(made, "kind string, name string, cand string, cfreq long, done array<int>").where("done is not null"))
    prices = GUESS
    for _ in range(ROUNDS):
        prices = estimated(best_of(could, prices, "done"))
    best = best_of(could, prices, "cand").withColumnRenamed("got", "root")
    links = toks.select("kind", "name").join(best, ["kind", "name"], "left").withColumn("root", F.coalesce("root", "name"))
    links = follow(cut(links))

    # second step: what names a company by its first word alone
    alone = links.where("kind = 'company' and root = name").join(toks.drop("id"), ["kind", "name"])
    owners = alone.join(links.groupBy("kind", "root").agg(F.count("*").alias("n")).withColumnRenamed("root", "name"), ["kind", "name"])

    def openers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ks = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                w = next((x for x in t if x not in STOP), None)
                if w:
                    k = {w, *(w[:j] + w[j + 1 :] for j in range(len(w) if len(w) > 3 else 0))}
                    at += [i] * len(k)
                    ks += sorted(k)
            took = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(ks, pa.string())], names=["name", "toks", "key"])

    opened = cut(owners.select("name", "toks").mapInArrow(openers, "name string, toks array<string>, key string"))
    near = opened.alias("v").join(opened.alias("c"), "key").where(F.col("v.name") != F.col("c.name")).select(F.col("v.name").alias("name"), F.col("v.toks").alias("toks"), F.col("c.name").alias("cand"), F.col("c.toks").alias("ctoks")).distinct()

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [stands_for(v, c, shared.value.get("company", frozenset())) for v, c in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ok)], names=["name", "cand", "ok"])

    only = near.mapInArrow(fits, "name string, cand string, ok boolean").where("ok").groupBy("name").agg(F.count("*").alias("n"), F.min("cand").alias("cand")).where("n = 1").select(F.lit("company").alias("kind"), F.col("name").alias("root"), "cand")
    return links.join(only, ["kind", "root"], "left").select("kind", "name", F.coalesce("cand", "root").alias("root"))


def best_of(could: DataFrame, prices: list[float], what: str) -> DataFrame:
    """(kind, name, got): for each name `what` of the candidate with the highest posterior at the prices."""
    score = F.log("cfreq") - sum((F.col("done")[i] * F.lit(p) for i, p in enumerate(prices)), F.lit(0.0))
    return could.groupBy("kind", "name").agg(F.max_by(what, F.struct(score.alias("s"), "cfreq", F.length("cand").alias("n"), "cand")).alias("got"))


def estimated(attached: DataFrame) -> list[float]:
    """Prices from the deeds of the attached pairs: minus the log of each deed's rate, a few made-up pairs at the guessed rates keeping rare deeds from 0."""
    got = attached.agg(F.count("*").alias("n"), *[F.sum(F.col("got")[i]).alias(d) for i, d in enumerate(DEEDS)]).first()
    weight = 20.0
    return [-math.log(((got[d] or 0) + weight * r) / ((got["n"] or 0) + weight)) if (got[d] or 0) + weight * r < (got["n"] or 0) + weight else 0.0 for d, r in DEEDS.items()]


def follow(links: DataFrame) -> DataFrame:
    """Every name with the root its links lead to; each round doubles the distance covered, until nothing moves (links lead up the ranks, so none turns back)."""
    while True:
        up = links.select("kind", F.col("name").alias("root"), F.col("root").alias("next"))
        moved = cut(links.join(up, ["kind", "root"], "left").select("kind", "name", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links


def pairs(roots: DataFrame) -> DataFrame:
    """(kind, name_a, name_b): all pairs of spellings of one entity, the smaller name first."""
    a, b = roots.select("kind", "root", F.col("name").alias("name_a")), roots.select("kind", "root", F.col("name").alias("name_b"))
    return a.join(b, ["kind", "root"]).where("name_a < name_b").select("kind", "name_a", "name_b")
