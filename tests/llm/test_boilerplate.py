"""Bodies of texts with and without line breaks, regions and their price."""

from itertools import product

from millrace.llm import boilerplate, labelled_pages


def test_unknown_names_at_the_edges_stay():
    w = boilerplate.weights(built=False)
    body = "Drusile Dobru Financial is not a bank. Banking services are provided by Kradodrato Vuhipa"
    assert boilerplate.flat_body(body, w) == body
    got = boilerplate.flat_body("Careers | Press | Pricing | Support | Legal " + body, w)
    assert got == body


def test_text_without_known_words_is_body():
    w = boilerplate.weights(built=False)
    assert boilerplate.flat_body("Drusile Dobru Zzqivo", w) == "Drusile Dobru Zzqivo"
    assert boilerplate.flat_body("", w) == boilerplate.flat_body("  ", w) == ""


def test_furniture_alone_has_no_body():
    assert boilerplate.flat_body("Careers | Press | Pricing | Support | Legal", boilerplate.weights(built=False)) == ""


def test_regions_sum_to_the_most():
    for scores in product([-1.5, -0.4, 0.3, 2.0], repeat=5):
        for cost in (0.25, 1.0):
            value = lambda m: sum(s for s, i in zip(scores, m) if i) - cost * sum(i and not (k and m[k - 1]) for k, i in enumerate(m))
            best = max(value(m) for m in product([False, True], repeat=5))
            assert abs(value(boilerplate.inside(list(scores), cost)) - best) < 1e-9
    assert boilerplate.inside([], 1.0) == []


def test_neighbours_decide_doubtful_lines():
    assert boilerplate.inside([-3, 0.5, -3], 1.0) == [False] * 3  # weak line among furniture
    assert boilerplate.inside([3, -0.5, 3], 1.0) == [True] * 3  # weak line within the body
    assert boilerplate.inside([3, -1.5, 3], 1.0) == [True, False, True]  # a region more is worth its price


def test_recall_on_held_out_patterns():
    w = boilerplate.weights()
    held = labelled_pages.lines(6, 9, held=True)
    right = sum((boilerplate.line_score(boilerplate.normal(s), w) > 0) == bool(y) for s, y in held)
    assert right / len(held) > 0.85


def test_defined_cases(spark):
    text = "Home | About us | Careers | Log in\n\nThe minimum opening deposit is $25.\nFollow us on social media"
    rows = [(1, text, "x"), (2, None, "x"), (3, "", None), (4, "one line only", None), (4, text, None), (None, "\n\n", None), (6, "We charge $5 for each transfer.\n" * 5000, None)]
    df = spark.createDataFrame(rows, "id long, t string, line_no string")
    got = sorted(((r.row_id, r.line_no) for r in boilerplate.outside_lines(df, "id", "t", "tab").collect()))
    assert got == [(1, 1), (1, 4), (4, 1), (4, 4)]
    bodies = {(r.row_id, r.body) for r in boilerplate.bodies(df.where("id < 6"), "id", "t", "tab").collect()}
    assert (2, None) in bodies and (3, "") in bodies and (1, "\nThe minimum opening deposit is $25.") in bodies
    assert boilerplate.outside_lines(df.where("false"), "id", "t", "tab").count() == 0
