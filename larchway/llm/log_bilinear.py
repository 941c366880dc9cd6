"""Operator 4: scoring by a log-bilinear model trained with noise-contrastive estimation.

Tokens are lower-cased (A-Z) words and one end per text. A token's code is a 64-bit hash whose low byte is its class, a
hash of its last two characters. The model predicts one of M outputs: the most frequent words, the class of any other
word, or the end. A word of a class has its smoothed share of the class, so token probabilities are normalised.

1. All training texts are counted: (code, count) of every distinct token, summed before and after the shuffle.
2. Every text becomes output numbers. Codes outside a table of bounded size with the most frequent ones are joined to
   the counts; the others are looked up in it.
3. Counts of neighbouring outputs over all training texts group the outputs by what surrounds them (spectral k-means),
   which tells languages and styles apart. A token's context is the word before it and the group that leads among the
   WINDOW tokens before it.
4. Counts of (group, word before, output) over all training texts are the examples. With r_v the vector of the word
   before, u_h that of the group, q_w and b_w those of the output, the score of w is (C1 r_v + C2 u_h) . q_w + b_w. It
   is trained in numpy by noise-contrastive estimation, each context's K noise draws taken in expectation, in batches of
   contexts.
5. Batched matrix products over all contexts give log-probabilities, normalised over the outputs, a table of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchway.llm.common import Memo, Scratch, once, text_or_empty

M, CLASSES = 1024, 256
WORDS = M - CLASSES - 2
END, START = M - 2, M - 1
GROUPS, WINDOW = 8, 64
#: Codes in the table that tasks look counts up in.
TABLE = 500_000
END_CODE = -1
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall


def code(word: bytes) -> int:
    c = xxhash.xxh3_64_intdigest(word) & ~0xFF | xxhash.xxh3_64_intdigest(word[-2:]) & 0xFF
    return min(c, 2**64 - 2)  # the last one is the end's


def codes(text: str) -> np.ndarray:
    """Codes of a text's tokens; the end's is -1, which no word has."""
    memo = once("codes", lambda: Memo(code, 250_000))
    memo.trim()
    words = _words(text.encode("utf-8", "surrogatepass").lower())
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    out[-1] = 2**64 - 1
    return out.view(np.int64)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def token_counts(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            c, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(n.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(codes(text.as_py()))
                size += len(held[-1])
                if size > 3_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return train.select(text_or_empty().alias("text")).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the tokens at least as frequent as the lowest count that leaves at most `most`; sorted by code."""
    sizes = sorted(((r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for n, k in sizes:
        total += k
        if total > most:
            break
        least = n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = counts.where(F.col("n") >= least).toArrow()
    c, n = table.column("code").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(c)
    return c[order], n[order]


def numbered(docs: DataFrame, key: str, table) -> DataFrame:
    """A row for each text: output numbers, the sums over tokens in the table, the codes of the others."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("outputs", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_all", pa.float64()), ("log_class", pa.float64()), ("others", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, logs, outputs = table.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                each = [codes(t.as_py()) for t in part.column(2)]
                every = np.concatenate(each)
                spot = np.minimum(np.searchsorted(top, every), max(len(top) - 1, 0))
                known = top[spot] == every if len(top) else np.zeros(len(every), bool)
                number = np.where(known & (outputs[spot] >= 0), outputs[spot], WORDS + ((every & 0xFF) % CLASSES)) if len(top) else WORDS + (every & 0xFF)
                number = np.where(every == END_CODE, END, number).astype("<u2")
                log = np.where(known, logs[spot], 0.0) if len(top) else np.zeros(len(every))
                ends = np.cumsum([len(e) for e in each])
                starts = ends - [len(e) for e in each]
                in_class = (number >= WORDS) & (number < END)
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), log, np.where(in_class, log, 0.0))]
                others = [every[s:e][~known[s:e]] for s, e in zip(starts, ends, strict=True)]
                n = len(each)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column(0), part.column(1), pa.array([number[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()), pa.array(ends - starts), *(pa.array(s) for s in sums), pa.array(others, pa.list_(pa.int64()))], schema=schema)
                row += n

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "row bigint, doc_id bigint, held_out boolean, outputs binary, n_tokens bigint, n_known bigint, log_all double, log_class double, others array<bigint>")


def contexts(blobs: list, group: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts together: output, word before, leading group among the tokens before, first token of each text."""
    each = [np.frombuffer(b, "<u2") for b in blobs]
    out = np.concatenate(each).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([len(e) for e in each])[:-1]]).astype(np.int64)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[starts] = START
    lead = np.zeros_like(out)
    if group is not None:
        first = np.repeat(starts, [len(e) for e in each])
        at = np.arange(len(out))
        low = np.maximum(first, at - WINDOW)
        seen = np.zeros((len(out) + 1, GROUPS), np.int32)
        member = group[out]
        seen[1:][np.nonzero(member >= 0)[0], member[member >= 0]] = 1
        np.cumsum(seen, axis=0, out=seen)
        lead = (seen[at] - seen[low]).argmax(1)
    return out, before, lead, starts


def cells(rows: DataFrame, group) -> DataFrame:
    """(block, counts): how often each (group, word before, output) occurs, summed by blocks of 2^16 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(cell, np.arange(0, GROUPS * M * M + 1, 1 << 16))
            full = [b for b in range(len(cuts) - 1) if cuts[b] < cuts[b + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()) for x in ((cell & 0xFFFF).astype("<u2"), n.astype("<u4")))], names=["block", "low", "n"])

        for batch in batches:
            for at in range(0, len(batch), 512):
                out, before, lead, _ = contexts([b.as_buffer() for b in batch.column(0)[at : at + 512]], group)
                held.append((lead * M + before) * M + out)
                size += len(out)
                if size > 3_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def whole(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << 16, np.int64)
        for low, n in zip(table.column("low"), table.column("n"), strict=True):
            total[np.frombuffer(low.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<u4")
        at = np.nonzero(total)[0]
        return pa.table({"block": table.column("block")[:1], "low": pa.array([at.astype("<u2").tobytes()], pa.binary()), "total": pa.array([total[at].tobytes()], pa.binary())})

    parts = rows.where("NOT held_out").select("outputs").mapInArrow(run, "block int, low binary, n binary")
    return parts.groupBy("block").applyInArrow(lambda _, t: whole(t), "block int, low binary, total binary")


def gathered(parts: DataFrame, groups: int) -> np.ndarray:
    out = np.zeros(groups * M * M, np.float32)
    for r in parts.toLocalIterator():
        out[(r["block"] << 16) + np.frombuffer(r["low"], "<u2").astype(np.int64)] = np.frombuffer(r["total"], np.int64)
    return out.reshape(groups, M, M)


def grouped(pairs: np.ndarray, seed: int = 4) -> np.ndarray:
    """The group of each output from the counts of neighbours; -1 for those too rare to tell."""
    both = pairs + pairs.T
    n = both.sum(1)
    use = np.nonzero((n >= 20) & (np.arange(M) < END))[0]
    out = np.full(M, -1)
    if len(use) < 4 * GROUPS:
        return out
    a = both[np.ix_(use, use)].astype(float)
    a = np.maximum(np.log((a + 0.5) * a.sum() / np.outer(a.sum(0) + 1, a.sum(1) + 1)), 0)
    values, vectors = np.linalg.eigh(a)
    x = vectors[:, -GROUPS:] * np.sqrt(np.maximum(values[-GROUPS:], 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rng, weight = np.random.default_rng(seed), np.sqrt(n[use])
    best = None
    for _ in range(8):
        centre = x[rng.choice(len(x), GROUPS, replace=False, p=weight / weight.sum())]
        for _ in range(40):
            near = (x @ centre.T).argmax(1)
            for g in range(GROUPS):
                if (near == g).any():
                    centre[g] = (x[near == g] * weight[near == g, None]).sum(0)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        fit = (weight * (x * centre[near]).sum(1)).sum()
        if best is None or fit > best[0]:
            best = fit, near
    out[use] = best[1]
    return out


class LogBilinear:
    def __init__(self, size: int = 32, noise: float = 25.0, seed: int = 4):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {"r": make(M, size), "u": make(GROUPS, size), "q": make(M, size), "c1": np.eye(size, dtype=np.float32), "c2": np.eye(size, dtype=np.float32)}
        self.noise = noise

    def context(self, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.p["u"][h] @ self.p["c2"] + self.p["r"][v] @ self.p["c1"]

    def train(self, counts: np.ndarray, passes: int = 30, batch: int = 512, rate: float = 0.02, ridge: float = 1e-6) -> None:
        """counts: (groups, M, M). Batches of contexts; a context weighs as often as it occurs, to the power 3/4."""
        unigram = counts.sum((0, 1)).astype(np.float64) + 0.1
        unigram[START] = 1e-6
        noise = (unigram / unigram.sum()).astype(np.float32)
        self.p["b"] = np.log(noise)
        shift = np.log(self.noise * noise)
        seen = counts.sum(2)
        hs, vs = np.nonzero(seen)
        rng = np.random.default_rng(1)
        moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}
        step = 0
        for _ in range(passes if len(hs) else 0):
            order = rng.permutation(len(hs))
            for at in range(0, len(order), batch):
                h, v = hs[order[at : at + batch]], vs[order[at : at + batch]]
                n = seen[h, v]
                share = counts[h, v] / n[:, None]
                weight = (n**0.75 / (n**0.75).sum()).astype(np.float32)[:, None]
                x = self.context(h, v)
                s = 1 / (1 + np.exp(-np.clip(x @ self.p["q"].T + self.p["b"] - shift, -30, 30)))
                g = weight * (share * (1 - s) - self.noise * noise * s)  # of the objective, by score
                gx = g @ self.p["q"]
                grad = {k: -ridge * x_ for k, x_ in self.p.items()}
                grad["q"] = grad["q"] + g.T @ x
                grad["b"] = grad["b"] * 0 + g.sum(0)
                grad["c1"] = grad["c1"] + self.p["r"][v].T @ gx
                grad["c2"] = grad["c2"] + self.p["u"][h].T @ gx
                gr, gu = np.zeros_like(self.p["r"]), np.zeros_like(self.p["u"])
                np.add.at(gr, v, gx @ self.p["c1"].T)
                np.add.at(gu, h, gx @ self.p["c2"].T)
                grad["r"], grad["u"] = grad["r"] + gr, grad["u"] + gu
                step += 1
                for k, (m, s2) in moment.items():
                    m += 0.1 * (grad[k] - m)
                    s2 += 0.01 * (grad[k] ** 2 - s2)
                    self.p[k] = self.p[k] + rate * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-9)

    def table(self, batch: int = 1024) -> np.ndarray:
        """log10 probability of each output in each context (groups * M, M), normalised over the outputs."""
        out = np.empty((GROUPS * M, M), np.float32)
        h, v = np.divmod(np.arange(GROUPS * M), M)
        for at in range(0, len(out), batch):
            s = self.context(h[at : at + batch], v[at : at + batch]) @ self.p["q"].T + self.p["b"]
            s[:, START] = -np.inf
            top = s.max(1, keepdims=True)
            out[at : at + batch] = (s - top - np.log(np.exp(s - top).sum(1, keepdims=True))) / np.log(10)
        return out


def scored(rows: DataFrame, group, table) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = table.value.reshape(-1)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                out, before, lead, starts = contexts([b.as_buffer() for b in part.column(1)], group)
                own = logs[(lead * M + before) * M + out].astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.add.reduceat(own, starts))], names=["row", "model"])

    return rows.select("row", "outputs").mapInArrow(run, "row bigint, model double")


def score_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of `docs(key, text, ...)`.

    Learns from the rows that aren't held out, by the crc32 of their id; a null id is never held out. A null text counts
    as empty: one end. Repeated rows count as often as they occur. Without training rows both scores are 0: every token
    is then the one unseen. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    counts = scratch.table(token_counts(docs.where(~held_out(key))), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    base = float(np.log10(n + 0.1 * (v + 1)))
    top, often = frequent(counts, TABLE)
    words = np.lexsort((top, -often))
    words = words[top[words] != END_CODE][:WORDS]
    outputs = np.full(len(top), -1, np.int64)
    outputs[words] = np.arange(len(words))
    table = spark.sparkContext.broadcast((top, np.log10(often + 0.1), outputs))
    rows = scratch.table(numbered(docs, key, table), "rows")

    by_class = counts.where(F.col("code") != END_CODE).groupBy(F.col("code").bitwiseAND(F.lit(0xFF)).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class.collect():
        size[r["c"]], kinds[r["c"]] = r["n"], r["v"]
    np.subtract.at(size, top[words] & 0xFF, often[words])
    np.subtract.at(kinds, top[words] & 0xFF, 1)

    group = grouped(gathered(cells(rows, None), 1)[0])
    model = LogBilinear()
    model.train(gathered(cells(rows, group), GROUPS))
    logs = model.table()
    logs[:, WORDS : WORDS + CLASSES] -= np.log10(size + 0.1 * (kinds + 1)).astype(np.float32)
    final = scored(rows, group, spark.sparkContext.broadcast(logs))

    rest = rows.select("row", F.explode("others").alias("code")).join(counts, "code", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1).cast("double"))).alias("log_rest"), F.count("n").alias("known_rest"))
    out = rows.drop("outputs", "others").join(final, "row").join(rest, "row", "left")
    log_rest = F.coalesce("log_rest", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("log_all") + log_rest - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("model") + F.col("log_class") + log_rest).alias("score"),
    )
