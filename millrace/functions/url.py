"""URL expressions: parts, canonical forms, archive wrappers, link filters and scores.

Parsing is by expression, so a malformed address gives empty parts and never an error. Defined cases: a
null address gives null; an address without scheme has its scheme read as https; an empty one has empty parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def with_scheme(c: Column, scheme: str = "https://") -> Column:
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://") | (c == ""), c).otherwise(F.concat(F.lit(scheme), c))


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(with_scheme(c), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def host(c: Column) -> Column:
    """Lower-case host without port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(with_scheme(c), AUTHORITY, 1)), r"^www\.|:\d+$", "")


def path(c: Column) -> Column:
    return F.regexp_extract(with_scheme(c), PATH, 1)


def base(c: Column) -> Column:
    """Scheme and authority of an address."""
    return F.regexp_extract(with_scheme(c), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def canonical(c: Column) -> Column:
    """Without parameters, query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[;?#].*$", ""), r"/+$", "")


def is_pdf(c: Column) -> Column:
    return F.endswith(F.lower(path(c)), F.lit(".pdf"))


def unwrap(c: Column, archive: str = "web.archive.org") -> Column:
    """The address inside any number of archive wrappers, without query, fragment and trailing slash.

    Protocol-relative forms are completed first; null for what is no http address or still points into the archive.
    """
    s = F.trim(c)
    s = F.regexp_replace(s, r"^/{2,3}(?=[^/])", "https://")
    s = F.when(F.startswith(s, F.lit("/web/")), F.concat(F.lit(f"https://{archive}"), s)).otherwise(s)
    dotted = archive.replace(".", r"\.")
    s = F.regexp_replace(s, rf"^(?:https?://{dotted}/web/[^/]+/(?=https?://))+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), r"/+$", "")
    return F.when(s.rlike(r"^https?://") & ~F.contains(host(s), F.lit(archive)), s)


def spaced_path(c: Column) -> Column:
    """Lower-case path with its separators as blanks."""
    return F.regexp_replace(F.lower(c), r"[-_/]", " ")


def relevance(path_col: Column, names: Column, topics: Column, good: list[str], bad: list[str], weights: tuple[int, int, int, int] = (10, 3, 2, 20)) -> Column:
    """Score of a path: for each name word and each of the first five topic words it holds, each good and each bad part of it."""
    w_name, w_topic, w_good, w_bad = weights
    spaced, low = spaced_path(path_col), F.lower(path_col)
    score = F.size(F.filter(names, lambda t: F.contains(spaced, t))) * w_name + F.size(F.filter(F.slice(topics, 1, 5), lambda t: F.contains(spaced, t))) * w_topic
    for p in good:
        score = score + F.when(F.contains(low, F.lit(p)), w_good).otherwise(0)
    for p in bad:
        score = score - F.when(F.contains(low, F.lit(p)), w_bad).otherwise(0)
    return score


def matches_rules(path_col: Column, anchor: Column, *, reject_starts: list[str], path_has: list[str], anchor_has: list[str]) -> Column:
    """Whether a link is worth following: its path starts with no rejected part, and path or anchor hold a wanted one."""
    low, said = F.lower(path_col), F.lower(F.coalesce(anchor, F.lit("")))
    out = F.lit(False)
    for p in path_has:
        out = out | F.contains(low, F.lit(p)) | F.contains(said, F.trim(F.replace(F.lit(p), F.lit("/"), F.lit(" "))))
    for a in anchor_has:
        out = out | F.contains(said, F.lit(a))
    no = F.lit(False)
    for r in reject_starts:
        no = no | F.startswith(low, F.lit(r)) | (low == r.rstrip("/"))
    return out & ~no


def candidates(base_url: Column, paths: list[str]) -> Column:
    """(ordinal, url) of every path that a probe would try below a base address."""
    root = F.regexp_replace(base_url, r"/+$", "")
    return F.array(*[F.struct(F.lit(i).alias("ordinal"), F.concat(root, F.lit(p)).alias("url")) for i, p in enumerate(paths)])


def shrinking(url: Column) -> Column:
    """Addresses that come out as the last path segment is dropped again and again, longest first."""
    parts = F.filter(F.split(F.regexp_replace(path(url), r"^/", ""), "/"), lambda p: p != "")
    ns = F.when(F.size(parts) > 0, F.sequence(F.size(parts), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(ns, lambda n: F.concat(base(url), F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
