import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from larchway.llm import byte_bpe, components, embedding_forest, jaccard, line_dedup, log_bilinear, packing, piece_codec, quality, token_counts, toxicity, warc
from larchway.llm.common import Scratch
from larchway.llm.queries import vocabulary

ODD = ["", " ", "\n \n", "a", "I'm  we'll 'so !'s 're're", "İΣ ﬁ é 中文 🙂", "<|endoftext|>x<|startoftext|>", "<s>▁a ▁</s>", "\x1c a\x85b  ", "x'" * 300 + "a" * 700]
WORDS = "the of and lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor".split()
SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall


def texts(n, seed=3):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randint(1, 120))) for _ in range(n)]


def documents(spark, rows, extra=True):
    """(doc_id, text), with columns whose names clash with those the operators make."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    return df.selectExpr("*", "'x' AS n", "1 AS class", "2 AS score", "3 AS words", "'en' AS lang", "'s' AS source", "0L AS n_chars") if extra else df


@pytest.fixture(scope="module")
def mixed(spark):
    return documents(spark, [*enumerate(ODD + texts(12)), (900, None), (None, "no id"), (3, "a"), (3, "a")])


def test_tokenizers_equal_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(1)
    some = ODD + texts(20) + ["".join(rng.choice("abcthe'srvlmd ,.!1é İß中🙂\n<|>▁") for _ in range(rng.randint(1, 50))) for _ in range(500)]
    big, small = (Tokenizer.from_file(vocabulary(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    bpe, machine = byte_bpe.ByteBPE(vocabulary("byte_bpe_50k.json")), token_counts.Transducer(vocabulary("word_bpe_49k.json"))
    pieces, sp = piece_codec.PieceCodec(vocabulary("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    counts = machine.counts(some)
    for text, n in zip(some, counts, strict=True):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == big.encode(text, add_special_tokens=False).ids
        assert n == len(small.encode(text, add_special_tokens=False).ids), text
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == ids
        assert pieces.decode(pieces.encode(text)) == sp.decode(ids)


def test_packing_is_a_partition(spark, mixed):
    bpe = byte_bpe.ByteBPE(vocabulary("byte_bpe_50k.json"))
    rows = packing.pack_documents(mixed, vocabulary("byte_bpe_50k.json")).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for pieces in by_sequence.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total
            total += length
        assert total <= 1024 and total & (total - 1) == 0  # nothing is padded
    got = collections.Counter()
    for key, part in itertools.groupby(sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])), lambda r: r["doc_id"]):
        got[key] += sum(r["length"] for r in part)
    want = collections.Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += len(bpe.encode(r["text"] or "")) // 4 + 1
    assert got == want


def test_counts_and_codec_rows(spark, mixed):
    rows = mixed.collect()
    counts = token_counts.count_tokens(mixed, vocabulary("word_bpe_49k.json")).collect()
    assert sorted(r["n_bytes"] for r in counts) == sorted(len((r["text"] or "").encode()) for r in rows)
    coded = piece_codec.encode_and_decode(mixed, vocabulary("piece_bpe_32k.model")).collect()
    assert len(coded) == len(rows)
    assert next(r for r in coded if r["doc_id"] == 900)["decoded"] == ""


def test_quality_measures_and_ablations(spark, mixed):
    def plain(text):
        words = SPLIT(text)
        windows = collections.defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        return len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)})

    for text in ODD + ["a b c a b c d", "a a a a", "a b a b a b"] + texts(20):
        assert dict(zip(quality.MEASURES, quality.measure(text), strict=True))["n_repeat_words"] == plain(text)
    judged = quality.apply_policy(quality.ledger(mixed, keep=("text", "n")), "v1")
    assert {"doc_id", "text", "n", "failed", "kept"} <= set(judged.columns) and judged.count() == mixed.count()
    rows = judged.collect()
    for r in quality.ablations(judged, "v1").collect():
        bit = 1 << [n for n, _ in quality.rules()].index(r["rule"])
        assert r["n_failed"] == sum(bool(x["failed"] & bit) for x in rows) and r["n_failed_alone"] == sum(x["failed"] == bit for x in rows)


def test_lines(spark):
    a = "one two three four five six seven eight nine ten"
    long_ = " ".join(f"w{i}" for i in range(40))
    docs = [(1, f"{a}\nshort line\n{long_}"), (2, f"{a}\nshort line"), (3, a.replace("four", "FOUR")), (4, a.replace("four ", "")), (5, long_ + " w40"), (6, a.replace("one", "x").replace("ten", "y")), (7, None), (8, ""), (None, f"{a} {long_}")]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, docs)).collect()}
    assert out[1]["text"] == docs[0][1] and out[2]["text"] == ""
    assert [out[i]["text"] for i in (3, 4, 5)] == ["", "", ""]
    assert out[6]["text"] == docs[5][1] and out[7]["text"] is None and out[8]["text"] == "" and out[None]["_n_removed"] == 0
    assert out[3]["n"] == "x"
    assert line_dedup.dedup_lines(documents(spark, docs).where("false")).count() == 0


def test_lines_equal_brute_force(spark):
    """Short and long lines, lengths at which blocks change, edits at either end, null and repeated ids, repeated rows."""
    rng = random.Random(11)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n)] for n in (0, 1, 2, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 127, 128, 129, 130, 300) for _ in range(2)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.choice([0, len(words) - 1, rng.randrange(len(words) + 1)])
            words[max(at, 0) : at + rng.randrange(2)] = rng.choice([[], ["zz"], [rng.choice("abc")]])
        return rng.choice([" ", " ", "\t", " \x0b "]).join(words) + rng.choice(["", " "])

    rows = [(rng.choice([i, i, i, None, 5]), "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(70)]
    rows += [rows[3], rows[9], (None, None), (None, ""), (400, None)]

    def near(x, y):
        if abs(len(x) - len(y)) > 1 or min(len(x), len(y)) < 8:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
        x, y = sorted((x, y), key=len)
        return any(y[:k] + y[k + 1 :] == x for k in range(len(y)))

    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    placed = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            placed[(-(2**63) if i is None else i, hashes[t], k)] = tuple(SPLIT(x))
    first = {}
    for place in sorted(placed):
        first.setdefault(placed[place], place)
    gone = {p for p, x in placed.items() if x and (first[x] < p or any(near(x, y) and first[y] < first[x] for y in first))}
    want = []
    for i, t in rows:
        parts = (t or "").split("\n")
        left = [x for k, x in enumerate(parts) if (-(2**63) if i is None else i, hashes[t], k) not in gone]
        want.append((i, None if t is None else "\n".join(left), 0 if t is None else len(parts) - len(left)))
    got = [(r["doc_id"], r["text"], r["_n_removed"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_lines_are_split_once(spark):
    """No filter of the plan splits texts again, and texts that lose no line aren't split to be counted."""
    out = line_dedup.dedup_lines(documents(spark, [(1, "a b\na b"), (2, "c")]))
    plan = out.select("_n_lines", "_n_removed")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and not out.schema["_n_removed"].nullable and not out.schema["_n_lines"].nullable
    assert sorted((r["doc_id"], r["_n_lines"], r["_n_removed"], r["text"]) for r in out.collect()) == [(1, 2, 1, "a b"), (2, 1, 0, "c")]


@pytest.mark.parametrize("light", [jaccard.LIGHT, 2])  # at 2 the dense join has work to do
def test_jaccard_equals_brute_force(spark, monkeypatch, light):
    dense, members = jaccard.dense_links, []
    monkeypatch.setattr(jaccard, "LIGHT", light)
    monkeypatch.setattr(jaccard, "dense_links", lambda m, *rest: members.append(m.count()) or dense(m, *rest))
    rng = random.Random(2)
    base = [t.split() for t in texts(25, 8)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "A b"), (503, "a B"), (504, "a"), (None, rows[0][1])]
    sets = {}
    for i, t in rows:
        w = SPLIT((t or "").lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    name = {i: i for i in sets}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = [i for i in sets if i is not None]
    for a, b in itertools.combinations(ids, 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            name[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents(spark, rows)).collect()}
    assert {i: got[i] for i in ids} == {i: (len(sets[i]), find(i)) for i in ids}
    assert got[None] == (len(sets[0]), find(0))
    assert light > 2 or sum(members) > 0
    assert jaccard.jaccard_components(documents(spark, rows).where("false")).count() == 0


def test_jaccard_of_long_texts_in_crowded_tokens(spark, monkeypatch):
    """Three texts that share 15,700 shingles of 18,000 and so don't link, and a near copy of one of them."""
    monkeypatch.setattr(jaccard, "LIGHT", 2)
    core = [f"c{i}" for i in range(15_700)]
    rows = [(i, " ".join(core + [f"x{i}y{k}" for k in range(2_300)])) for i in range(3)]
    rows.append((3, rows[2][1] + " z"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents(spark, rows)).collect()}
    assert got == {0: (17_997, 0), 1: (17_997, 1), 2: (17_997, 2), 3: (17_998, 2)}


def test_jaccard_bounds_the_bytes_of_batches(spark, monkeypatch):
    """While the operator runs, Python gets batches of some 2 MB, not 10,000 rows of any size; the setting is put back."""
    before, survey, seen = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), jaccard.survey, []

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)

    def spy(docs, *rest):
        seen.extend(r["n"] for r in docs.mapInArrow(sizes, "n long").collect())
        return survey(docs.where("false"), *rest)

    monkeypatch.setattr(jaccard, "survey", spy)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 800) AS text")
    assert jaccard.jaccard_components(docs).count() == 0
    assert sum(seen) > 12e6 and max(seen) < 1.1 * jaccard.BATCH
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 50), (70, 70), (99, 40)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 60: 50, 99: 40, 40: 40}


def test_vectors(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        v = rng.standard_normal(16) if i < 150 else np.array(rows[i - 150][1]) + 0.02 * rng.standard_normal(16)
        rows.append((i, v.tolist(), i % 3 if i < 150 else (i - 150) % 3))
    rows += [(300, rows[0][1], rows[0][2]), (301, [0.0] * 16, 1), (302, None, 1), (303, rows[0][1], None), (304, [math.nan] * 16, 1), (305, [1.0], 1), (306, [2.0], 1)]
    got = {r["vec_id"]: r for r in embedding_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=32, small=16).collect()}
    assert len(got) == len(rows)
    found = total = 0
    for i, v, label in rows:
        near = [j for j, o, other in rows if j != i and v and o and len(v) == len(o) and label == other and label is not None and np.linalg.norm(v) > 0 and np.linalg.norm(o) > 0 and np.dot(v, o) / np.linalg.norm(v) / np.linalg.norm(o) >= 0.98]
        assert got[i]["n_links"] <= len(near)
        found, total = found + got[i]["n_links"], total + len(near)
    assert found >= 0.95 * total > 0
    assert got[303]["n_links"] == 0 and got[300]["component_id"] == 0 and got[305]["n_links"] == 1


def test_log_bilinear(spark):
    rng = random.Random(4)
    french, english = [f"mot{i}" for i in range(40)], [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(french if i % 2 else english) for _ in range(40))) for i in range(200)] + [(900, None), (901, "unseen"), (None, "")]
    got = {r["doc_id"]: r for r in log_bilinear.score_texts(documents(spark, rows)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = collections.Counter(t for i, text in rows if i is None or not held(i) for t in [*SPLIT((text or "").lower()), "\n"])
    n, v = sum(counts.values()), len(counts)
    for i, text in rows[:60] + rows[200:202]:
        tokens = [*SPLIT((text or "").lower()), "\n"]
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
    mine = [i for i, _ in rows[:200] if held(i)]
    assert sum(got[i]["score"] for i in mine) > sum(got[i]["base_score"] for i in mine)
    model = log_bilinear.LogBilinear()
    model.train(np.random.default_rng(0).integers(0, 3, (log_bilinear.GROUPS, log_bilinear.M, log_bilinear.M)).astype(np.float32)[:, :, :], passes=1, batch=4096)
    assert np.allclose((10.0 ** model.table()[::997]).sum(1), 1, atol=1e-4)
    assert log_bilinear.score_texts(documents(spark, rows).where("false")).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(WORDS, k=60)
        toxic = i % 5 == 0
        if toxic:
            for bad in rng.sample(["idiotic", "moronic", "scummy", "trashy"], 2):
                words[rng.randrange(60)] = bad
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs, given = documents(spark, [*rows, (900, None)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, given)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    assert 0 <= got[900] < toxicity.THRESHOLD
    assert toxicity.score(docs, toxicity.train(docs, given.where("false"))).where("score >= 0.3").count() == 0


def test_warc_round_trip(spark):
    page = '<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>A &amp; b</title><script>var t="</p>";</script></head><body><h1>A &amp; b</h1><p>One<br>two <a href="/x">x</a></p><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "https://a.example/d/", page), (2, None, None), (1, "https://a.example/d/", page), (None, "u\r\nX: y", "<p>z")], "page_id long, url string, html string").selectExpr("*", "'x' AS record")
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 12
    stream = b"".join(r["record"] for r in rows)
    for r in rows:
        headers, block, stream = warc.parse(stream)
        assert headers["WARC-Type"] == r["record_type"] and headers["WARC-Record-ID"] == r["record_id"] and headers.get("WARC-Refers-To") == r["refers_to"]
        assert headers["WARC-Block-Digest"] == warc.digest(block) and "X" not in headers
    assert not stream
    one = {r["record_type"]: r for r in rows[:3]}
    assert one["metadata"]["refers_to"] == one["conversion"]["refers_to"] == one["response"]["record_id"]
    assert warc.parse(one["conversion"]["record"])[1].decode() == "A & b\nOne\ntwo x"
    assert b"outlink: https://a.example/x\r\n" in warc.parse(one["metadata"]["record"])[1]
    assert warc.parse(one["response"]["record"])[1].endswith(page.encode())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    make = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(90))
    clean = [make() for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100, clean[0]), (101, "too short"), (102, "buy now " * 60), (103, make() + "\n" + clean[1]), (104, None)]
    documents(spark, rows, extra=False).selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r["doc_id"] for r in got.select("doc_id").collect()}) == [*range(30), 103]
    bpe = byte_bpe.ByteBPE(vocabulary("byte_bpe_50k.json"))
    ids = {}
    for r in sorted(got.collect(), key=lambda r: (r["doc_id"], r["start"])):
        ids[r["doc_id"]] = ids.get(r["doc_id"], b"") + bytes(r["ids"])
    assert all(ids[i] == bpe.encode(clean[i]) + bytes(4) for i in range(30))
    assert ids[103] == bpe.encode(rows[33][1].split("\n")[0]) + bytes(4)
    assert hashlib.sha256(ids[0]).hexdigest()
