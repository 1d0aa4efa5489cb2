"""Slots, filler and notices against natural text, by the models alone."""

import numpy as np

from millrace.llm import labelled_residue, residue


def test_every_form_of_slot_is_found():
    t = residue.tables()
    texts = [form % name for form in labelled_residue.SLOT_FORMS[:16] for name in ("apr", "rate2", "RATE_1", "_fee", "customer.first_name")]
    got, _ = residue.judge(texts, t)
    assert (got == 1).mean() > 0.98


def test_slots_in_fields_and_natural_marks():
    texts = ["$apr$", "{rate2}", "[RATE 1]", "Fee: {{ fee }} a month", "$5 to $25,000", "4.25% APY", "See note [2] and {\"a\": 5}.", "if (x > 0) { y(); }"]
    got, _ = residue.judge(texts, residue.tables())
    assert got.tolist() == [1, 1, 1, 1, 0, 0, 0, 0]


def test_text_that_speaks_of_notices_is_no_notice():
    texts = ["404 Not Found", "Lorem ipsum dolor sit amet", "TBD%", "Our API returns 404 if no account has that id, and it says why in the body of the answer.", "Savings Account | Fees and limits"]
    got, _ = residue.judge(texts, residue.tables())
    assert got.tolist() == [3, 2, 2, 0, 0]


def test_recall_and_precision_on_held_out_folds():
    kinds, found = [], []
    for fold in range(labelled_residue.FOLDS):
        held = labelled_residue.values(31, fold, held=True)
        got, _ = residue.judge([t for _, t in held], residue.tables(fold))
        kinds += [c for c, _ in held]
        found += got.tolist()
    kinds, found = np.array(kinds), np.array(found)
    assert (found[kinds == "slot"] == 1).mean() > 0.95
    assert (found[kinds == "notice"] == 3).mean() > 0.75
    assert (found[kinds == "natural"] > 0).mean() < 0.06


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " nan ", None), (4, "{{a}}" + " The account has no monthly fee." * 3000, "x"), (5, "{{a}}", None), (5, "{{a}}", None), (None, "TBD", None)]
    df = spark.createDataFrame(rows, "id long, t string, text string")
    got = sorted(((r.row_id, r.kind) for r in residue.find(df, "id", "t", "tab").collect()), key=str)
    assert got == [(4, "slot"), (5, "slot"), (5, "slot"), (None, "filler")]
    assert residue.find(df.where("false"), "id", "t", "tab").count() == 0
