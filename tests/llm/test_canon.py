"""Every entry within the allowed slips is a candidate, however short it is."""

import random
from collections import Counter

from millrace.llm import canon


def index(entries, values=()):
    rarity = Counter()
    for f in [*(f for f, _ in entries), *values]:
        rarity.update(canon.trigrams(f))
    return canon.Index(entries, dict(rarity))


def test_slips_in_the_shortest_entries():
    ix = index([("cd", 103), ("p2p", 122), ("bnpl", 114), ("pension", 130), ("bill pay", 124), ("mortgage", 117)])
    for form, ident in (("bnpl", 114), ("pension", 130), ("bill pay", 124), ("mortgage", 117)):
        assert ix.best(form)[2] == ident
        for i in range(len(form)):
            assert ix.best(form[:i] + "q" + form[i + 1 :])[2] == ident
            if i and len(form) > 4:
                assert ix.best(form[:i] + form[i + 1 :])[2] == ident
            assert ix.best(form[:i] + form[i : i + 2][::-1] + form[i + 2 :])[2] == ident
    assert ix.best("cq")[2] == -1


def test_capitals_inside_a_word_are_not_parted():
    ix = index([("bnpl", 114), ("pension", 130)])
    form = canon.category_form
    assert ix.best(form("BNeL"), form(canon.unparted("BNeL")))[2] == 114


def test_candidates_are_all_within_the_slips():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("at ") for _ in range(n)).strip()
    entries = [(w, i) for i, w in enumerate(sorted({word(rng.randint(3, 20)) for _ in range(200)} - {""}))] + [("tatatatat", 900)]
    values = [word(rng.randint(3, 20)) or "a" for _ in range(200)] + ["tatataatt"]
    ix = index(entries, values)
    for v in values:
        want = {i for f, i in entries if canon.slips(v, f, 3) <= min(canon.allowed(v), canon.allowed(f))}
        assert {ix.entries[e][1] for _, _, e in ix.similar(v)} == want


def test_blocks_of_the_list_agree(spark, monkeypatch):
    rows = [(v,) for v in ("pension", "pensoin", "mortgage", "mortgagge", "bill pay", "xyz", "", None, "pension")]
    df = spark.createDataFrame(rows, "v string")
    entries = [("bill pay", 124), ("mortgage", 117), ("pension", 130)]
    whole = sorted(map(tuple, canon.match(df, "v", entries, canon.category_form).collect()))
    monkeypatch.setattr(canon, "BLOCK", 1)
    assert sorted(map(tuple, canon.match(df, "v", entries, canon.category_form).collect())) == whole
    assert dict(whole) == {"pension": 130, "pensoin": 130, "mortgage": 117, "mortgagge": 117, "bill pay": 124, "xyz": -1}


def test_defined_cases(spark):
    rows = [(1, "Pension", "x"), (1, "pensionn", "x"), (2, None, "x"), (3, "  ", None), (4, "nothing like it", None)]
    df = spark.createDataFrame(rows, "id long, v string, canonical string")
    got = sorted((r.id, r.v, r.canonical_id) for r in canon.resolve(df, "v", [("pension", 130)], canon.category_form, ["Pension"]).collect())
    assert got == [(1, "pensionn", 130), (4, "nothing like it", -1)]
    assert canon.resolve(df, "v", [], canon.category_form, []).where("canonical_id <> -1").count() == 0
    assert canon.resolve(df.where("false"), "v", [("pension", 130)], canon.category_form, ["Pension"]).count() == 0
