"""Text expressions: normal forms, sentences, keywords, mentions and chunks, all as built-in Spark columns.

Defined cases, for every function here: a null text gives null (a null array for functions that give
arrays); an empty text gives an empty text or an empty array; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words without meaning of their own in product names
STOPWORDS = ["the", "a", "an", "for", "and", "or", "of", "by", "in", "on", "to", "with", "from", "at", "is", "it", "as"]
# fixed values: suffixes of the crude stemmer
SUFFIXES = ["ings", "ing", "tion", "sion", "ment", "ness", "able", "ible", "ous", "ive", "ers", "er", "es", "s"]
# fixed values: words that announce the end of a product, as patterns
ENDINGS = [r"\bdiscontinued\b", r"\bsunset(?:ted|ting)?\b", r"\bshut\s*down\b", r"\bwound\s*down\b", r"\bceased\b", r"\bwinds?\s*down"]
# fixed values: the sentence that ties a product to the bank behind it
PAIR = r"(?i)([A-Z][^.]{0,80}?)\s+(?:is|are)\s+(?:held\s+with|issued\s+by|backed\s+by|provided\s+by)\s+([^,.]+?)(?=\.|,|\)|$)"
SENTENCE_END = r"(?<=[.!?])\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; inside a lambda an outer expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without outer white space of any kind (`trim` takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Every stretch of white space as one blank, outer white space gone."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def normal(c: Column) -> Column:
    """Lower-case letters and digits of ASCII with single blanks between."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def bare_name(c: Column) -> Column:
    """Lower-case name without what stands in parentheses."""
    return F.lower(F.regexp_replace(strip(F.regexp_replace(c, r"\(.*?\)", "")), r"\s+", " "))


def slug(c: Column, kept: str = r"\w\-.", most: int = 80) -> Column:
    """File-system name: every other character as an underscore, cut to `most`; the cut is the feature."""
    return F.substring(F.regexp_replace(c, f"[^{kept}]", "_"), 1, most)


def tidy(c: Column) -> Column:
    """Without NUL characters, at most one blank line in a row and one blank between words."""
    return strip(F.regexp_replace(F.regexp_replace(F.translate(c, "\0", ""), r"\n{3,}", "\n\n"), r" {2,}", " "))


def one_line(c: Column) -> Column:
    """NULs dropped and line ends as blanks, so that the value fits one CSV line."""
    return strip(F.regexp_replace(F.translate(c, "\0", ""), r"[\r\n]+", " "))


def legal_form_free(c: Column, patterns: list[str]) -> Column:
    """`c` with each pattern removed in turn, ignoring case; then collapsed."""
    for p in patterns:
        c = F.regexp_replace(c, f"(?i){p}", "")
    return collapse(c)


def hint(c: Column, relation: str) -> Column:
    """The other name in '(rebrand from X)' or '(rebranded to X)'; null if there is none."""
    return F.nullif(F.regexp_extract(c, rf"(?i)\(rebrand(?:ed)?\s+{relation}\s+([^)]+)\)", 1), F.lit(""))


def former_names(c: Column, least: int = 3, most: int = 80) -> Column:
    """All names in 'formerly known as / called / named X', of a length within the bounds."""
    got = F.regexp_extract_all(c, F.lit(r"(?i)formerly (?:known as|called|named) ([^.(,;]+?)(?:\.|\(|,|;|\s+Rebranded|\s+in\s+\d)"), F.lit(1))
    return F.filter(F.transform(got, strip), lambda x: F.length(x).between(least, most))


def end_year(c: Column, first: int = 2000, last: int = 2026, endings: list[str] = ENDINGS) -> Column:
    """Least year within the bounds that follows a word of ending within the sentence; null if none does."""
    tail = r"[^.]{0,80}?(\b(?:19|20)\d{2}\b)"
    years = F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(f"(?i){p}{tail}"), F.lit(1)) for p in endings]))
    return F.array_min(F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y.between(first, last)))


def issuer_pairs(c: Column, pattern: str = PAIR) -> Column:
    """(product, bank) of every sentence that says which bank holds, issues, backs or provides a product."""
    whole = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.transform(whole, lambda m: F.struct(strip(F.regexp_extract(m, pattern, 1)).alias("product"), strip(F.regexp_extract(m, pattern, 2)).alias("bank")))


def generic(c: Column, words: list[str]) -> Column:
    """Whether a name has no letters or only words of the list."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]+"), F.lit(0))
    return F.forall(parts, lambda w: w.isin(words))


def short(c: Column, most: int = 4) -> Column:
    """Whether a name has at most `most` characters other than blanks."""
    return F.length(F.replace(c, F.lit(" "), F.lit(""))) <= most


def keywords(c: Column, stop: list[str] = STOPWORDS) -> Column:
    """Lower-case words of a name of three letters or more, run-together capitals parted, without stop words."""
    parted = F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9 ]", " "), r"([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(parted), " +"), lambda w: (F.length(w) > 2) & ~w.isin(stop))


def name_tokens(name: Column, other: Column) -> Column:
    """Words of three letters or more of a name, after the words of the other name and parentheses are cut out."""
    gone = F.filter(F.split(F.lower(F.coalesce(other, F.lit(""))), r"\s+"), lambda w: F.length(w) > 2)
    bare = F.aggregate(gone, F.lower(name), lambda s, w: F.replace(s, w, F.lit("")))
    bare = strip(F.regexp_replace(F.regexp_replace(bare, r"\([^)]*\)", ""), r"[^a-z0-9\s]", ""))
    return F.filter(F.split(bare, r"\s+"), lambda w: F.length(w) > 2)


def stem(word: Column) -> Column:
    """Word without up to two suffixes and a final e; a stem keeps three letters."""
    cut = rf"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(word, cut, "$1"), cut, "$1"), r"^(.{3,})e$", "$1")


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_END)


def paragraphs(c: Column, least: int = 10) -> Column:
    """Trimmed lines and paragraphs of `least` characters or more."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n|\n"), strip), lambda p: F.length(p) >= least)


def unique_sentences(c: Column) -> Column:
    """The text with repeated sentences dropped; the first spelling stays, white space does not tell two apart.

    Sorting by key and looking one place back keeps this n log n for texts of any length.
    """
    parts = F.filter(F.transform(F.split(c, SENTENCE_END + r"|\n\n+"), strip), lambda s: s != "")
    keyed = F.array_sort(F.transform(parts, lambda s, i: F.struct(F.regexp_replace(s, r"\s+", " ").alias("k"), i.alias("i"), s.alias("s"))))
    first = let(keyed, lambda ks: F.filter(ks, lambda x, i: (i == 0) | (F.get(ks, i - 1)["k"] != x["k"])))
    return F.array_join(F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"]), " ")


def contains_any(c: Column, needles: list[str]) -> Column:
    """Whether the lower-cased text contains one of the needles."""
    low = F.lower(c)
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(low, F.lit(n))
    return out


def mention_share(text: Column, words: Column) -> Column:
    """Share of the words that the normalised text contains; 1 where there are no words to look for."""
    low = F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", " ")
    share = lambda b: F.when(F.size(b["w"]) == 0, 1.0).otherwise(F.size(F.filter(b["w"], lambda w: F.contains(b["t"], w))) / F.size(b["w"]))
    return let(F.struct(low.alias("t"), words.alias("w")), share)


def mentions(text: Column, words: Column, least: float = 0.5) -> Column:
    return mention_share(text, words) >= least


def around_mentions(text: Column, words: Column, least: float = 0.5) -> Column:
    """The paragraphs of a text that mention a name, a blank line between them; empty if none does."""
    return F.array_join(F.filter(paragraphs(text), lambda p: mentions(p, words, least)), "\n\n")


def focus(text: Column, words: Column, whole: int = 2000, half: int = 2000) -> Column:
    """A text of up to `whole` characters as it is; of a longer one the paragraphs with a word, else its head and tail.

    Head and tail stand for a page without any of the words; this digest is the feature.
    """
    kept = F.filter(paragraphs(text), lambda p: let(F.lower(p), lambda low: F.exists(words, lambda w: F.contains(low, w))))
    ends = F.concat(F.left(text, F.lit(half)), F.lit("\n[...]\n"), F.right(text, F.lit(half)))
    joined = let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, "\n\n")))
    return F.when(F.length(text) <= whole, text).otherwise(F.coalesce(joined, ends))


def with_neighbours(parts: Column, hit: Callable[[Column], Column]) -> Column:
    """The parts that are hits and those just before or after one, in order."""

    def kept(b: Column) -> Column:
        at = lambda i: F.coalesce(F.get(b["hits"], i), F.lit(False))
        return F.filter(b["parts"], lambda _, i: at(i - 1) | at(i) | at(i + 1))

    return let(parts, lambda p: let(F.struct(p.alias("parts"), F.transform(p, hit).alias("hits")), kept))


def chunks(text: Column, most: int) -> Column:
    """The text in chunks of whole sentences, each as long as fits into `most` characters; a longer sentence is its own chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        full = (F.length(acc["now"]) > 0) & (F.length(acc["now"]) + F.length(s) + 1 > most)
        longer = F.when(F.length(acc["now"]) > 0, F.concat(acc["now"], F.lit(" "), s)).otherwise(s)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(longer).alias("now"))

    cut = F.aggregate(sentences(text), start, step, lambda acc: F.when(F.length(acc["now"]) > 0, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(cut)
