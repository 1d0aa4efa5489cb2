"""Text, address, date, JSON, similarity and page functions on hand-made values."""

import random

from pyspark.sql import functions as F

from millrace.functions import dates, fuzzy, html, jsons, text, url


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first().x


def test_text_forms(spark):
    assert one(spark, " A\t b\n", text.collapse) == "A b"
    assert one(spark, "Q2 (Beta)  Plus", text.bare_name) == "q2 plus"
    assert one(spark, "X (rebranded to Y Z)", lambda c: text.hint(c, "to")) == "Y Z"
    assert one(spark, "X", lambda c: text.hint(c, "to")) is None
    assert one(spark, "Formerly known as Alpha Pay. Formerly called B. formerly named Gamma in 2010", text.former_names) == ["Alpha Pay", "Gamma"]
    assert one(spark, "It was sunset in 2019 and wound down by 2018. Ceased 1999.", text.end_year) == 2018
    assert one(spark, None, text.end_year) is None
    assert one(spark, "PayFlex for the Win 24", text.keywords) == ["pay", "flex", "win"]
    assert [one(spark, w, text.stem) for w in ("savings", "lending", "rates", "use", "payments")] == ["sav", "lend", "rat", "use", "pay"]
    assert one(spark, "The Bank, N.A.", lambda c: text.generic(c, ["the", "bank", "n", "a"])) is True


def test_sentences(spark):
    assert one(spark, "A b.  C!\n\nA  b. D", text.unique_sentences) == "A b. C! D"
    assert one(spark, "", text.unique_sentences) == ""
    got = one(spark, "one. two. hit. four. five. hit.", lambda c: text.with_neighbours(text.sentences(c), lambda s: F.contains(s, F.lit("hit"))))
    assert got == ["two.", "hit.", "four.", "five.", "hit."]
    assert one(spark, "aa. bb. cc. dd.", lambda c: text.chunks(c, 8)) == ["aa. bb.", "cc. dd."]
    assert one(spark, "", lambda c: text.chunks(c, 8)) == [""]
    assert one(spark, None, lambda c: text.chunks(c, 8)) is None
    assert one(spark, "x" * 30 + ". yy.", lambda c: text.chunks(c, 8)) == ["x" * 30 + ".", "yy."]
    assert one(spark, "The Alpha Card is issued by Beta Bank, Member FDIC.", text.issuer_pairs)[0].bank == "Beta Bank"


def test_focus(spark):
    words = F.array(F.lit("fee"))
    assert one(spark, "short", lambda c: text.focus(c, words)) == "short"
    assert one(spark, "a fee of ten\n" + "z" * 3000, lambda c: text.focus(c, words)) == "a fee of ten"
    assert one(spark, "z" * 5000, lambda c: text.focus(c, words)) == "z" * 2000 + "\n[...]\n" + "z" * 2000


def test_addresses(spark):
    assert one(spark, "www.A.example/x", url.host) == "a.example"
    assert one(spark, "https://a.example:80/x;p?q#f", url.canonical) == "https://a.example:80/x"
    assert one(spark, "//a.example/x/?q", url.unwrap) == "https://a.example/x"
    assert one(spark, "/web/2020/https://web.archive.org/web/2019/http://a.example/", url.unwrap) == "http://a.example"
    assert one(spark, "mailto:a@b", url.unwrap) is None
    assert one(spark, "https://web.archive.org/about", url.unwrap) is None
    assert one(spark, "https://a.example/x/y", url.shrinking) == ["https://a.example/x/y", "https://a.example/x"]
    assert spark.range(1).select(html.resolve(F.lit("https://a.example/x/"), F.lit("../y")).alias("x")).first().x == "https://a.example/y"


def test_dates(spark):
    assert str(one(spark, "033176", dates.quarter_end)) == "1976-03-31"
    assert one(spark, "13", dates.quarter_end) is None
    assert str(one(spark, "FFIEC 03311999.txt", dates.file_quarter)) == "1999-03-31"
    assert str(one(spark, "1998-H2", dates.period_end)) == "1998-12-31"
    assert one(spark, "20190102.txt", dates.name_year) == 2019
    assert one(spark, '<a href="/x/call8403-zip.zip">', dates.quarter_links)[0].mm == "03"


def test_json(spark):
    assert one(spark, '<think>{</think>```json\n{"a": 1}\n```', jsons.answer_json) == '{"a": 1}'
    assert one(spark, 'Sure {"a": {"b": 2}} ok', jsons.answer_json) == '{"a": {"b": 2}}'
    assert one(spark, "no {", jsons.answer_json) is None
    assert one(spark, "['20200101000000', 'x', '2020']", jsons.timestamp_list) == ["20200101000000"]
    got = one(spark, "h/Big_Co/My_Card__terms__slug_20200101000000.html", lambda c: jsons.file_parts(c, ["terms"]))
    assert tuple(got) == ("Big Co", "My Card", "terms", "20200101000000")


def test_similarity_against_plain_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert fuzzy.common(a, b) == plain(a, b)
    assert fuzzy.token_sort("bank of a", "a of bank") == 100.0
    assert fuzzy.weighted("", "x") == 0.0 and fuzzy.ratio("", "") == 100.0
    assert fuzzy.token_set("alpha bank", "alpha bank of texas") == 100.0


def test_pages():
    source = "<html><head><title> T &amp; U</title><style>x</style></head><body><nav>Home</nav><main>" + "word " * 60 + '<a href="/x/">X</a></main><footer>Member FDIC</footer><a href="http://b.example/">B</a><a href="?q">Q</a></body>'
    page = html.read(source)
    assert html.title_of(page) == "T & U"
    assert "Home" in html.visible_text(page) and "Home" not in html.main_text(page) and "FDIC" not in html.main_text(page)
    assert [x["path"] for x in html.internal_links(page, "https://www.a.example/p")] == ["/x", "/p"]
    assert not html.is_shell(page, source)
    assert html.is_shell(html.read('<div id="root"></div>'), '<div id="root"></div>')
    assert html.is_shell(html.read("<script></script>" * 5), "<script></script>" * 5)
    broken = html.read("<p>a<b>b</p>c<footer>plain</footer>")
    assert html.main_text(broken) == "a\nb\nc"
    assert html.main_text(html.read("<footer>Insured by x</footer>t")) == "Insured by x\nt"
