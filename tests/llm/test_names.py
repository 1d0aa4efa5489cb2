"""Names of shared or short words only meet their variants."""


from millrace.llm import names


def test_name_without_rare_word_meets_its_slip(spark):
    rows = [("product", "Business Checking", 40), ("product", "Busines Checking", 1), ("product", "Zorvim Tarnel Savings", 30), ("company", "Q2 Financial", 30), ("company", "Q2 Finnancial", 1)]
    # names that make the type words shared
    rows += [("product", f"{w} {t}", 5) for w in "Abavo Ebeko Idisu Ofomu Ugupa Akelo Emiri Onasa Upeta Arivo".split() for t in ("Business Checking",)]
    rows += [("company", f"{w} Financial", 5) for w in "Abavo Ebeko Idisu Ofomu Ugupa Akelo Emiri Onasa Upeta Arivo".split()]
    got = {(r.kind, r["name"]): r.root for r in names.attribute(spark.createDataFrame(rows, "kind string, name string, freq long")).collect()}
    assert got["product", "Busines Checking"] == "Business Checking"
    assert got["company", "Q2 Finnancial"] == "Q2 Financial"
    assert got["product", "Abavo Business Checking"] == "Abavo Business Checking"


def test_pairs_are_found_as_by_looking_at_all(spark):
    """The keys and filters lose no pair that the channel would accept: every accepted pair of a random set is linked."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    bases = [f"{word().title()} {word().title()} {t}" for t in ("Credit Card", "Savings Account", "Personal Loan") for _ in range(12)]
    rows = [("product", b, 50 + i) for i, b in enumerate(dict.fromkeys(bases))]
    for b in bases:
        w = b.split()
        i = rng.randint(1, len(w[0]) - 2)
        rows += [("product", n, 1) for n in {f"{w[0][:i]}{w[0][i + 1:]} {' '.join(w[1:])}", f"{w[0]}{w[1].lower()} {' '.join(w[2:])}", f"{w[0]} {w[1]} {w[2][:4]} {w[3]}", b.lower()} if n not in bases]
    rows = list({n: (k, n, f) for k, n, f in rows}.values())
    got = {r["name"]: r.root for r in names.attribute(spark.createDataFrame(rows, "kind string, name string, freq long")).collect()}
    shared = frozenset(names.SHARED["product"])
    for _, v, f in rows:
        could = [c for _, c, g in rows if g > f and names.deeds(names.words(v), names.words(c), shared, "product") is not None]
        assert (got[v] != v) == bool(could) or got[v] in could, (v, got[v], could)


def test_defined_cases(spark):
    df = spark.createDataFrame([("company", "Velor Makin Inc.", 9), ("company", "Velor Makin", 2), ("company", "  ", 5), ("company", None, 5), ("product", "Velor Makin", 1)], "kind string, name string, freq long")
    got = {(r.kind, r["name"]): r.root for r in names.attribute(df).collect()}
    assert got == {("company", "Velor Makin Inc."): "Velor Makin Inc.", ("company", "Velor Makin"): "Velor Makin Inc.", ("product", "Velor Makin"): "Velor Makin"}
    assert names.attribute(df.where("false")).count() == 0


def test_long_chains_are_followed(spark):
    links = spark.createDataFrame([("k", f"n{i}", f"n{max(0, i - 1)}") for i in range(40)], "kind string, name string, root string")
    assert {r.root for r in names.follow(links).collect()} == {"n0"}
