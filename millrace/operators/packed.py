"""Fields that pack several values into one string.

`fit` infers the delimiters of each field by scoring every candidate delimiter on two things:
how regularly the pieces it makes have the item type of the field, and how consistently it makes
two or more of them. `split` then cuts each value at the accepted delimiters and numbers the items.

Defined cases: a null or blank value, and a value of delimiters only, has no items; items are
trimmed of blanks, enclosing quotes and list brackets; empty pieces are dropped before numbering;
repeats keep their own numbers; delimiters inside a balanced pair of double quotes do not separate.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text

# Candidate delimiters: name -> regular expression of the delimiter itself.
CANDIDATES = {
    "semicolon": ";",
    "comma": ",",
    "pipe": r"\|",
    "slash": "/",
    "newline": r"[\r\n]",
    "tab": r"\t",
    "plus": r"\+",
    "ampersand": "&",
    "blank": r"\s",
    "and": r"(?<=\s)[Aa][Nn][Dd](?=\s)",
}
# Item types in the order in which they are tried, where the caller names none. A path type separates only behind its extension.
TYPES = {
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "path": r"^[^\s\"']*\.html?$",
    "label": r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$",
    "name": r"^\S.*$",
}
PATH_TAIL = r"(?i)\.html$"
PATH_END = r"(?i)(?<=\.html)"
# Private characters that stand in for quoted delimiters.
OPEN, STAND_IN = chr(0xE00F), "".join(chr(0xE010 + i) for i in range(12))
PLAIN = ";,|/\r\n\t+&"
# what a value must hold for a candidate to be tried at all, by plain search
SIGNS = {"semicolon": [";"], "comma": [","], "pipe": ["|"], "slash": ["/"], "newline": ["\n", "\r"], "tab": ["\t"], "plus": ["+"], "ampersand": ["&"], "blank": [" ", "\t", "\n"], "and": ["and", "AND", "And"]}


@dataclass
class DelimiterModel:
    """Item type and accepted delimiters of each field, with the scores they were chosen by."""

    types: dict[str, str] = field(default_factory=dict)
    accepted: dict[str, list[str]] = field(default_factory=dict)
    scores: list[tuple[str, str, int, float, float]] = field(default_factory=list)
    tail: str = ""


def _bare(c: Column) -> Column:
    """Without outer blanks, quotes and list brackets."""
    return F.regexp_replace(c, r"^[\s\"'\[\]]+|[\s\"'\[\]]+$", "")


def _cutter(names: list[str], item_type: str, tail: str) -> str:
    """Regular expression that cuts a value of the item type at the named delimiters; a comma before a name's tail does not separate."""
    each = [CANDIDATES[n] + (tail if n == "comma" and item_type == "name" else "") for n in names]
    if item_type == "path":
        return PATH_END + r"[\"']?(?:\s*(?:" + "|".join(each) + r")[\s\"']*)+"
    return "|".join(each)


def fit(df: DataFrame, fields: list[str], types: dict[str, str] = TYPES, tail: str = "", least_regular: float = 0.9, least_consistent: float = 0.9) -> DelimiterModel:
    """Item type and delimiters of each field, from all rows; two passes over them, a few rows of result each.

    types: item types in the order of trial, with the pattern of an item; 'name' must be among them, as what a
    field has that fits none. tail: look-ahead for what follows a comma within a name. The type of a field is the
    first that most values without any candidate delimiter have (a path type: most values end in its
    extension). A delimiter is scored on the values that hold it and no other candidate: the share of their
    pieces that have the item type (regularity) and the share of those values that come out as two or more
    pieces, all of that type (consistency). It is accepted if both reach their bounds. One that is seen but never alone is
    scored in the same way on the pieces that the accepted ones leave. A field without values keeps no delimiter.
    """
    model = DelimiterModel(tail=tail)
    every = "|".join(rx for n, rx in CANDIDATES.items() if n != "blank")
    shape = []
    for f in fields:
        v = _bare(F.col(f))
        plain = (v != "") & ~v.rlike(every)
        shape += [F.count_if(plain).alias(f"{f}#plain"), F.count_if(v != "").alias(f"{f}#all")]
        shape += [F.count_if((v != "") & v.rlike(PATH_TAIL) if t == "path" else plain & v.rlike(rx)).alias(f"{f}#{t}") for t, rx in types.items()]
    got = df.agg(*shape).first()
    for f in fields:
        total = {t: got[f"{f}#all"] if t == "path" else got[f"{f}#plain"] for t in types}
        model.types[f] = next((t for t in types if total[t] and got[f"{f}#{t}"] >= 0.8 * total[t]), "name")
        model.accepted[f] = []
    # each value is trimmed once, and asked for each candidate once
    trimmed = df.select(*[F.regexp_replace(F.col(f), r"^[\s\[]+|[\s\];,|]+$", "").alias(f"v{i}") for i, f in enumerate(fields)])
    flags = []
    for i, f in enumerate(fields):
        v = F.col(f"v{i}")
        for name in CANDIDATES:
            # the plain search comes first: most values hold one or two of the candidates
            held = reduce(lambda a, b: a | b, [F.contains(v, F.lit(x)) for x in SIGNS[name]])
            flags.append((held & v.rlike(_cutter([name], model.types[f], tail))).alias(f"h{i}#{name}"))
    asked = trimmed.select("*", *flags)
    tries = []
    for i, f in enumerate(fields):
        t = model.types[f]
        for name in CANDIDATES:
            others = [~F.col(f"`h{i}#{n}`") for n in CANDIDATES if n not in (name, "blank")]
            parts = F.filter(F.transform(F.split(F.col(f"v{i}"), _cutter([name], t, tail)), _bare), lambda p: p != "")
            sized = text.let(parts, lambda ps: F.struct(F.size(ps).alias("n"), F.size(F.filter(ps, lambda p: p.rlike(types[t]))).alias("typed")))
            alone = reduce(lambda a, b: a & b, others, F.lit(True))
            tries.append(F.when(F.col(f"`h{i}#{name}`"), F.struct(F.lit(f).alias("field_name"), F.lit(name).alias("name"), F.when(alone, sized).alias("s"))))
    scored = _scored(asked, tries, 2) if tries else []
    _accept(model, scored, least_regular, least_consistent)
    # a delimiter that never stands alone is scored on what the accepted ones leave
    # (blanks that never do are the padding of others)
    open_ = {(r.field_name, r.name) for r in scored if not r.rows and r.name != "blank"}
    if open_:
        tries = []
        for f, name in sorted(open_):
            i, t = fields.index(f), model.types[f]
            if not model.accepted[f] or t == "path":
                continue
            pieces = F.split(F.col(f"v{i}"), _cutter(model.accepted[f], t, tail))
            cut = _cutter([name], t, tail)
            held = F.filter(pieces, lambda p: p.rlike(cut))
            parts = F.filter(F.transform(F.flatten(F.transform(held, lambda p: F.split(p, cut))), _bare), lambda p: p != "")
            sized = text.let(parts, lambda ps: F.struct(F.size(ps).alias("n"), F.size(F.filter(ps, lambda p: p.rlike(types[t]))).alias("typed")))
            tries.append(F.when(F.col(f"`h{i}#{name}`"), F.struct(F.lit(f).alias("field_name"), F.lit(name).alias("name"), sized.alias("s"))))
        if tries:
            _accept(model, _scored(asked, tries, 1), least_regular, least_consistent)
    return model


def _scored(asked: DataFrame, tries: list[Column], least: int) -> list:
    """At most fields x candidates rows: how often a candidate was seen, and the pieces it made where it made `least` or more."""
    one = asked.select(F.explode(F.array_compact(F.array(*tries))).alias("t")).select("t.field_name", "t.name", "t.s.n", "t.s.typed")
    made = F.col("n") >= least
    return one.groupBy("field_name", "name").agg(F.count_if(made).alias("rows"), F.sum(F.when(made, F.col("typed"))).alias("typed"), F.sum(F.when(made, F.col("n"))).alias("n"), F.count_if(made & (F.col("typed") == F.col("n"))).alias("whole")).collect()


def _accept(model: DelimiterModel, scored: list, least_regular: float, least_consistent: float) -> None:
    for r in sorted(r for r in scored if r.rows):
        regular, consistent = r.typed / r.n, r.whole / r.rows
        model.scores.append((r.field_name, r.name, r.rows, round(regular, 4), round(consistent, 4)))
        if regular >= least_regular and consistent >= least_consistent:
            model.accepted[r.field_name].append(r.name)


def items(value: Column, model: DelimiterModel, name: str) -> Column:
    """Array of the items of one field value, in written order; null for a null value."""
    kept = model.accepted.get(name) or []
    kind = model.types.get(name, "name")
    s = F.regexp_replace(value, r"^[\s\[]+|[\s\]]+$", "")
    if not kept:
        return F.filter(F.array(_bare(s)), lambda p: p != "")
    cut = _cutter(kept, kind, model.tail)
    if kind != "path":
        # quoted delimiters are stood in for by private characters while the value is cut
        parts = F.split(s, '"')
        shielded = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(F.translate(p, PLAIN, STAND_IN[: len(PLAIN)]), r"(?<=\s)([Aa][Nn][Dd])(?=\s)", OPEN + "$1")).otherwise(p))
        balanced = (F.size(parts) % 2 == 1) & ~s.rlike(r'^"[^"]*[;|\n][^"]*"[\s;]*$')
        s = F.when(F.contains(s, F.lit('"')) & balanced, F.array_join(shielded, '"')).otherwise(s)
    out = F.transform(F.split(s, cut), lambda p: _bare(F.translate(p, STAND_IN[: len(PLAIN)] + OPEN, PLAIN)))
    return F.filter(out, lambda p: p != "")


def split(df: DataFrame, id_col: str, fields: list[str], model: DelimiterModel, least: int = 1) -> DataFrame:
    """(field_name, id, item_no, item): one row per item of each field value with `least` or more items."""
    packed = F.array(*[F.struct(F.lit(f).alias("field_name"), items(F.col(f), model, f).alias("items")) for f in fields])
    one = df.select(F.col(id_col).alias("row_id"), F.explode(packed).alias("p")).where(F.size("p.items") >= least)
    return one.select(F.col("p.field_name").alias("field_name"), F.col("row_id").alias(id_col), F.posexplode("p.items").alias("pos", "item")).select("field_name", id_col, (F.col("pos") + 1).cast("int").alias("item_no"), "item")
