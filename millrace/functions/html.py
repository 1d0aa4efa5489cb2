"""Web pages: title, visible text, links and the signs of a script shell, from one pass of the standard parser.

Pages come through Arrow in batches. Defined cases: a null page gives null; broken markup is read as far
as it goes (an end tag closes the nearest open tag of its name, or nothing); NUL characters are dropped.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

# fixed values: elements without end tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: elements whose content is not shown
HIDDEN = frozenset("script style noscript iframe".split())
FURNITURE = frozenset("svg nav header".split())
# fixed values: what a footer must say to be kept
FOOTER_WORDS = ("fdic", "member fdic", "issued by", "provided by", "banking services", "insured", "chartered", "bank")
# fixed values: what a page says that needs scripts, and the marks of frameworks
SHELL_WORDS = ("javascript is required", "enable javascript", "javascript enabled", "this app works best with javascript", "you need to enable javascript", "please enable javascript", "requires javascript")
SHELL_MARKS = ("__next", "__nuxt", 'id="root"', 'id="app"', "ng-app", "data-reactroot")


class Page(HTMLParser):
    """Text pieces with the elements they stand in, links with their words, and counts."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # open elements, each with its number
        self.n = 0
        self.pieces: list[tuple[str, tuple[str, ...], tuple[int, ...]]] = []
        self.links: list[tuple[str, list[str]]] = []
        self.linked: list[tuple[int, list[str]]] = []
        self.mains: dict[str, int] = {}
        self.scripts = source.lower().count("<script")
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.n += 1
        held = dict(attrs)
        if tag in ("main", "article"):
            self.mains.setdefault(tag, self.n)
        if held.get("role") == "main":
            self.mains.setdefault("role", self.n)
        if tag == "a" and held.get("href") is not None:
            said: list[str] = []
            self.links.append((held["href"], said))
            self.linked.append((self.n, said))
        if tag not in VOID:
            self.open.append((tag, self.n))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                gone = {n for _, n in self.open[i:]}
                self.linked = [x for x in self.linked if x[0] not in gone]
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        s = data.strip()
        if s:
            self.pieces.append((s, tuple(t for t, _ in self.open), tuple(n for _, n in self.open)))
            for _, said in self.linked:
                said.append(s)


def _tidy(pieces: list[str]) -> str:
    return re.sub(r" {2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(pieces))).strip()


def read(source: str) -> Page:
    return Page(source.replace("\0", ""))


def title_of(page: Page) -> str:
    return "".join(s for s, tags, _ in page.pieces if "title" in tags)


def visible_text(page: Page) -> str:
    """All that is shown, furniture included."""
    return _tidy([s for s, tags, _ in page.pieces if not HIDDEN.intersection(tags)])


def main_text(page: Page, footer_words: tuple[str, ...] = FOOTER_WORDS, least: int = 200) -> str:
    """Shown text without navigation and header, with a footer only if it names one of the words; the main element alone if its text is longer than `least`."""
    hidden = HIDDEN | FURNITURE
    shown = [(s, tags, ns) for s, tags, ns in page.pieces if not hidden.intersection(tags)]
    foot: dict[int, list[str]] = {}
    for s, tags, ns in shown:
        for t, n in zip(tags, ns):
            if t == "footer":
                foot.setdefault(n, []).append(s)
    bad = {n for n, said in foot.items() if not any(w in "".join(said).lower() for w in footer_words)}
    shown = [x for x in shown if not bad.intersection(x[2])]
    main = next((page.mains[k] for k in ("main", "role", "article") if k in page.mains), None)
    inner = [s for s, _, ns in shown if main in ns]
    return _tidy(inner if sum(map(len, inner)) > least else [s for s, _, _ in shown])


def internal_links(page: Page, base_url: str) -> list[dict]:
    """Links to the host of the base address or its subdomains, the first of each path."""
    home = urlparse(base_url).netloc.replace("www.", "")
    out, seen = [], set()
    for href, said in page.links:
        href = href.strip()
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            continue
        try:
            whole = urljoin(base_url, href)
            parts = urlparse(whole)
        except ValueError:
            continue
        path = parts.path.rstrip("/") or "/"
        if home in parts.netloc.replace("www.", "") and path not in seen:
            seen.add(path)
            out.append({"href": whole, "anchor_text": "".join(said)[:200], "path": path})
    return out


def is_shell(page: Page, source: str) -> bool:
    """Whether a page needs scripts to show anything."""
    if any(any(w in s.lower() for w in SHELL_WORDS) for s, tags, _ in page.pieces if "noscript" in tags):
        return True
    n = len(" ".join(s for s, tags, _ in page.pieces if not HIDDEN.intersection(tags)))
    if n >= 500:
        return False
    return any(m in source[:5000].lower() for m in SHELL_MARKS) or page.scripts >= 5 and n < 200


LINK = StructType([StructField(n, StringType()) for n in ("href", "anchor_text", "path")])
PARSED = StructType([StructField("title", StringType()), StructField("visible", StringType()), StructField("main", StringType()), StructField("links", ArrayType(LINK)), StructField("is_shell", BooleanType())])


@F.pandas_udf(PARSED)
def parse(source: pd.Series, base_url: pd.Series) -> pd.DataFrame:
    """Everything of a page in one pass."""
    rows = []
    for s, u in zip(source, base_url):
        if s is None:
            rows.append((None, None, None, None, None))
            continue
        page = read(s)
        rows.append((title_of(page), visible_text(page), main_text(page), internal_links(page, u or ""), is_shell(page, s)))
    return pd.DataFrame(rows, columns=["title", "visible", "main", "links", "is_shell"])


@F.pandas_udf(StringType())
def resolve(base_url: pd.Series, href: pd.Series) -> pd.Series:
    """Relative addresses resolved against their base; null where either is null or they cannot be joined."""

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return None if b is None or h is None else urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base_url, href)], dtype=object)


def title(source: Column) -> Column:
    """Title by expression, for scans that need nothing else of the page."""
    return F.trim(F.regexp_extract(source, r"(?is)<title[^>]*>(.*?)</title>", 1))


def without_comments(source: Column) -> Column:
    return F.regexp_replace(source, r"(?s)<!--.*?-->", "")
