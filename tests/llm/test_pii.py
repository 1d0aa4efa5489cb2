"""Personal information: the field, its decoding and its defined cases."""

from itertools import product

import numpy as np
import pytest

from millrace.llm import labelled_pii, pii


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_lines_of_small_letters_are_decoded(field):
    text = "It works.\nping maribeth-morhurst [at] pemima [dot] invalid if you had the same problem\nwrite to joram.halgard@pema.test or text us, thx"
    got = pii.Finder(field).pieces([text])[0]
    assert [(text[a:b], kind) for a, b, kind in got] == [("maribeth-morhurst [at] pemima [dot] invalid", "email"), ("joram.halgard@pema.test", "email")]


def test_mailboxes_of_offices_are_learnt(field):
    texts = ["Write to help@orvanta.example for help.", "Contact support@thessik.com.", "Write to jorin.velmark@orvanta.example or text me."]
    got = [[t[a:b] for a, b, _ in p] for t, p in zip(texts, pii.Finder(field).pieces(texts))]
    assert got == [[], [], ["jorin.velmark@orvanta.example"]]


def test_blank_lines_have_no_pieces(field):
    assert pii.Finder(field).pieces(["", None, " \n\n\t"]) == [[], [], []]


def test_long_lines_are_decoded_whole(field):
    text = "The fee is low. " * 4000 + "My name is Jorin Velmark and my number is (212) 555-0143."
    got = pii.Finder(field).pieces([text])[0]
    assert {text[a:b] for a, b, _ in got} == {"Jorin Velmark", "(212) 555-0143"}


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    e, trans = rng.normal(size=(3, 4, pii.L)).astype(np.float32), rng.normal(size=(pii.L, pii.L)).astype(np.float32)
    lengths = np.array([4, 2, 1])
    got = pii.viterbi(e, trans, lengths)
    for b, n in enumerate(lengths):
        value = lambda p: pii.START[p[0]] + sum(e[b, i, y] for i, y in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:]))
        best = max(value(p) for p in product(range(pii.L), repeat=int(n)))
        assert abs(value(got[b, :n].tolist()) - best) < 1e-3


def test_recall_on_held_out_frames():
    finder = pii.Finder(pii.train(copies=16, epochs=5, part=False))
    want, got = set(), set()
    for i, (text, marks) in enumerate(labelled_pii.sentences(3, 77, held=True)):
        want |= {(i, text[a:b], k) for a, b, k in marks}
        got |= {(i, text[a:b], k) for a, b, k in finder.pieces([text])[0]}
    assert len(want & got) / len(want) > 0.65
    assert len(want & got) / len(got) > 0.8


def test_defined_cases(spark, field):
    text = "Call Jorin Velmark at (212) 555-0143. Again: (212) 555-0143."
    rows = [(1, text, "a"), (2, None, "b"), (3, "", None), (3, text, None)]
    df = spark.createDataFrame(rows, "id long, t string, kind string")
    got = sorted((r.id, r.kind, r.pii_text) for r in pii.find(df, "id", "t", field).collect())
    one = [("person_name", "Jorin Velmark"), ("phone", "(212) 555-0143")]
    assert got == [(i, *x) for i in (1, 3) for x in one]
    out = {(r.id, r.text) for r in pii.redact(df, "id", "t", field).collect()}
    assert out == {(1, "Call <PERSON_NAME> at <PHONE>. Again: <PHONE>."), (2, None), (3, ""), (3, "Call <PERSON_NAME> at <PHONE>. Again: <PHONE>.")}
    assert pii.find(df.where("false"), "id", "t", field).count() == 0
