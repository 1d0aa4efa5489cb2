"""Token ids against the public library, whole texts and defined cases."""

import random

from millrace.llm import encode


def texts():
    rng = random.Random(3)
    out = ["", "Hello, world! It's 3.50 €", "  two  blanks\n\n\ttab", "<|endoftext|> is text", "naïve café ½ 漢字 🙂🙂", "a" * 300, "\x00\x01 odd", "don't we'll I've"]
    out += ["".join(rng.choice("abc ABC123.,'\n\t-éß漢🙂") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    out += ["".join(chr(rng.randint(1, 0xD7FF)) for _ in range(80)) for _ in range(40)]
    return out


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(encode.VOCABULARY)
    rows = [(i, t) for i, t in enumerate(texts())] + [(9000, None), (9001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in encode.token_ids(df, "doc_id", "text").collect()}
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    for i, t in rows:
        if t is None or not t:
            assert got[i] == []
        elif not any(s in t for s in special):  # the library cuts out its special tokens, which are ordinary text here
            assert got[i] == tok.encode(t, add_special_tokens=False).ids, t
    assert encode.token_ids(df.where("false"), "doc_id", "text").count() == 0


def test_ids_decode_to_the_text(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(encode.VOCABULARY)
    long = "The fee is $5 a month. " * 20000
    got = encode.token_ids(spark.createDataFrame([(1, long), (1, "<|endoftext|>")], "doc_id long, text string"), "doc_id", "text").collect()
    assert {tok.decode(list(r.ids), skip_special_tokens=False) for r in got} == {long, "<|endoftext|>"}
