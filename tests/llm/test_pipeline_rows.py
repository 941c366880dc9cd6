"""Stages of the pipeline on equal lines, repeated and null ids."""

import corpus_pipeline
from larchway.llm import jaccard


def test_pipeline_removes_equal_lines_of_any_length(spark):
    long_ = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"short line\n\n{long_}\nx"), (2, f"keep\nshort  line\n\n{long_} more"), (3, "short line"), (4, "short lines\n\nx"), (None, "keep me")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}
    want = {1: docs[0][1], 2: "keep\n", 4: "short lines\n", None: "keep me"}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_pipeline_keeps_one_row_of_a_group(spark):
    """Repeated and null ids, alone and in groups with others; one id with two texts."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, d), (4, c), (5, None), (6, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_documents(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (None, b), (3, c), (3, d), (5, None), (6, None)], key=str)


def test_pipeline_compares_long_texts_in_crowded_tokens(spark, monkeypatch):
    """Three texts that share 15,700 words of 18,000 stay; a near copy of one of them goes."""
    monkeypatch.setattr(jaccard, "LIGHT", 2)
    core = " ".join(f"c{i}" for i in range(15_700))
    rows = [(i, " ".join([core, *[f"x{i}y{k}" for k in range(2_300)]])) for i in range(3)]
    rows.append((3, rows[2][1] + " z"))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, df, "").collect()) == [0, 1, 2]
