"""Row by row against the libraries: token counts and packed pieces, very long runs, null ids, equal rows."""

import random

import numpy as np
from tokenizers import Tokenizer

from larchway.llm import log_bilinear, packing, token_counts, toxicity
from larchway.llm.queries import vocabulary


def odd_rows():
    rng = random.Random(11)
    run = "".join(rng.choice("abcdethe'srvlm.,!19éß中") for _ in range(700))
    long = " ".join(rng.choice(["river", "Stone's", "don't", "1984", "中文", "--"]) for _ in range(6000))
    return [(1, run * 12), (2, "x" * 5000), (3, long), (4, None), (None, "no id"), (5, ""), (3, long), (6, "it's"), (6, "it's")]


def test_chunk_maps_equal_the_library():
    exact = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = [t or "" for _, t in odd_rows()]
    want = [len(exact.encode(t, add_special_tokens=False).ids) for t in texts]
    usual, cramped = token_counts.Transducer(vocabulary("word_bpe_49k.json")), token_counts.Transducer(vocabulary("word_bpe_49k.json"), most_states=50)
    assert usual.counts(texts).tolist() == want
    assert cramped.counts(texts).tolist() == want  # states are forgotten in the middle of a run
    assert usual.maps
    entries = {}
    for (entry, chunk), (after, n) in usual.maps.items():
        entries.setdefault(chunk, {})[entry] = after, n
        assert usual.run(entry, chunk) == (after, n)


def test_count_rows_equal_the_library(spark):
    exact = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = odd_rows()
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens"), vocabulary("word_bpe_49k.json")).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=key) == sorted(((i, len(exact.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=key)


def test_packed_ids_equal_the_library(spark):
    exact = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [r for i, r in enumerate(odd_rows()) if i not in (6, 8)]  # ids apart, so that pieces can be put together
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.json")).collect()
    for doc_id, text in rows:
        own = sorted((r for r in pieces if r["doc_id"] == doc_id), key=lambda r: r["start"])
        at = 0
        for r in own:
            assert (r["start"], len(r["ids"])) == (at, 4 * r["length"])
            at += r["length"]
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == [*exact.encode(text or "", add_special_tokens=False).ids, 0]


def test_every_class_of_rare_words_occurs():
    seen = {log_bilinear.code(f"{a}{b}".encode()) & 0xFF for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz0123456789"}
    assert len(seen) > 200 and any(c & 1 for c in seen)


def test_held_out_is_never_null(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert all(r[0] is not None for r in df.select(toxicity.held_out()).union(df.select(log_bilinear.held_out())).collect())
