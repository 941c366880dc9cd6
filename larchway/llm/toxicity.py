"""Operator 5: toxicity by weak supervision.

1. Candidates. From a bounded sample of labelled rows, words and word beginnings that toxic rows hold significantly more
   often become the entries of lexicons and patterns.
2. Voters. The strongest entries vote alone, the others in groups; some voters ask for two or more entries, some vote
   clean where a whole family of entries is absent, and the label given is one more voter of fixed accuracy.
3. Label model. Each voter has a table of vote probabilities for either class; expectation maximisation estimates the
   tables and the share of toxic rows. The correlations of votes inside the classes are estimated from the posteriors,
   and a voter's evidence is divided by how many voters it amounts to, itself included.
4. Classifier. A logistic regression over the entries learns the posterior labels; it scores every whole text.

Inputs of a score are the words of the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchway.llm.common import Memo, text_or_empty

_words = re.compile(r"[^\W\d_]+").findall
STARTS = (4, 5)
THRESHOLD = 0.3
#: How often the label given is held to be right.
LABEL_ACCURACY = 0.97


def entries_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:k]}*" for k in STARTS if len(word) > k))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most `per_class` training rows of either label, the first by hash; and how many there are."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    given = given.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = given.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), sizes


def candidates(sample: DataFrame, counts: dict[int, int], most: int, least_z: float) -> list[tuple[str, float]]:
    """Entries by falling significance of their log odds for toxic rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[y][w] for w in names], pa.int64()) for y in (1, 0))], names=["entry", "pos", "neg"])
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[y].update({e for w in set(_words(text.as_py().lower())) for e in entries_of(w)})
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield flush()
        yield flush()

    p, n = (F.lit(float(counts.get(y, 0) + 1)) for y in (1, 0))
    odds = F.log((F.col("pos") + 0.5) / p) - F.log((F.col("neg") + 0.5) / n)
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    total = sample.mapInArrow(count, "entry string, pos bigint, neg bigint").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = total.where("pos >= 3").withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "entry").limit(most)
    return [(r["entry"], r["z"]) for r in found.collect()]


class Entries:
    """Which entries a text holds."""

    def __init__(self, names: list[str]):
        index = {e: i for i, e in enumerate(names)}
        self.of = Memo(lambda w: [index[e] for e in entries_of(w) if e in index], 400_000)

    def __call__(self, text: str) -> list[int]:
        self.of.trim()
        return sorted({i for w in set(_words(text.lower())) for i in self.of[w]})


def voters(names: list[str], singles: int = 40, group: int = 25) -> list[tuple[np.ndarray, int, int]]:
    """(entries, at least so many, vote). A vote of -1 is cast where fewer are present, one of 1 where as many are; else abstain."""
    n = len(names)
    whole, starts = (np.array([i for i, e in enumerate(names) if e.endswith("*") == star], int) for star in (False, True))
    out = [(np.array([i]), 1, 1) for i in range(min(singles, n))]
    out += [(np.arange(k, min(k + group, n)), 1, 1) for k in range(singles, n, group)]
    for family in (whole, starts, np.arange(n), np.arange(min(singles, n))):
        if len(family):
            out += [(family, 2, 1), (family, 4, 1), (family, 1, -1)]
    return out


def cast(hits: list[list[int]], n: int, panel: list) -> np.ndarray:
    """Votes (rows x voters) in -1, 0, 1."""
    held = np.zeros((len(hits), n), bool)
    for r, h in enumerate(hits):
        held[r, h] = True
    out = np.zeros((len(hits), len(panel)), np.int8)
    for j, (entries, least, vote) in enumerate(panel):
        many = held[:, entries].sum(1) >= least
        out[:, j] = np.where(many, vote == 1, -(vote == -1) * 1)
    return out


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, dict]:
    """Posterior probability of toxic for each row, with accuracies and correlations of the voters. `given`: 0 or 1."""
    panel = np.column_stack([votes, np.where(given == 1, 1, -1)]).astype(np.int8)
    rows, m = panel.shape
    one_hot = np.stack([panel == v for v in (-1, 0, 1)]).astype(float)  # 3 x rows x voters
    post = np.clip(given.astype(float), 1 - LABEL_ACCURACY, LABEL_ACCURACY)
    weight = np.ones(m)
    for _ in range(rounds):
        share = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        tables = []
        for w in (1 - post, post):
            t = np.einsum("r,vrm->vm", w, one_hot) + 0.5
            tables.append(t / t.sum(0))
        for table, y in zip(tables, (0, 1), strict=True):  # the label given anchors the classes; its accuracy isn't estimated
            table[:, -1] = 1e-9
            table[2 * y, -1], table[2 - 2 * y, -1] = LABEL_ACCURACY, 1 - LABEL_ACCURACY
        spread = [panel - (w @ panel) / w.sum() for w in (1 - post, post)]
        cov = sum((s * w[:, None]).T @ s for s, w in zip(spread, (1 - post, post), strict=True)) / rows
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), -1, 1)
        weight = 1 / np.maximum(1, np.where(np.abs(corr) > 0.1, np.abs(corr), 0).sum(1))
        weight[-1] = 1
        evidence = np.einsum("vrm,vm,m->r", one_hot, np.log(tables[1] / tables[0]), weight)
        post = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + evidence, -30, 30)))
    right = [(np.where(panel == 1, post[:, None], 0) + np.where(panel == -1, 1 - post[:, None], 0)).sum(0) / np.maximum(1, (panel != 0).sum(0))]
    return post, {"accuracy": right[0], "correlation": corr, "weight": weight, "share": share}


def features(hits: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ones: the entries present, and whether there are at least one, two, four of them."""
    wide = [[*h, *(n + k for k, least in enumerate((1, 2, 4)) if len(h) >= least)] for h in hits]
    return np.repeat(np.arange(len(hits)), [len(w) for w in wide]), np.array([c for w in wide for c in w], int)


def fit(hits: list[list[int]], n: int, target: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    rows, cols = features(hits, n)
    w, b = np.zeros(n + 3), float(np.log(np.clip(target.mean(), 1e-4, 1 - 1e-4) / (1 - np.clip(target.mean(), 1e-4, 1 - 1e-4))))
    m = np.zeros(n + 4)
    s = np.zeros(n + 4)
    for t in range(1, rounds + 1):
        z = b + np.bincount(rows, w[cols], len(hits))
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(hits)
        g = np.append(np.bincount(cols, miss[rows], n + 3) + ridge * w, miss.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, most: int = 1500, least_z: float = 3.5) -> dict:
    """The model: entries, weights, bias, and what the label model found. Without rows of both labels it has no entries
    and its bias is the share of toxic rows there are (none: no toxic ones)."""
    sample, sizes = labelled_sample(docs, labels, per_class)
    total = max(1, sum(sizes.values()))
    prior = float(np.clip(sizes.get(1, 0) / total, 1e-4, 1 - 1e-4))
    plain = {"names": [], "w": np.zeros(3), "b": float(np.log(prior / (1 - prior))), "labels": {}}
    drawn = {y: min(per_class, sizes.get(y, 0)) for y in (0, 1)}
    if not drawn[0] or not drawn[1]:
        return plain
    names = [e for e, _ in candidates(sample, drawn, most, least_z)]
    if not names:
        return plain

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Entries(names)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([entries(t.as_py()) for t in batch.column(0)], pa.list_(pa.int32())), batch.column(1)], names=["hits", "toxic"])

    rows = sample.mapInArrow(held, "hits array<int>, toxic int").toPandas()
    if rows["toxic"].nunique() < 2:
        return plain
    hits, given = [list(h) for h in rows["hits"]], rows["toxic"].to_numpy()
    post, found = label_model(cast(hits, len(names), voters(names)), given)
    w, b = fit(hits, len(names), post)
    drawn_odds, odds = (given == 1).sum() / (given == 0).sum(), sizes[1] / sizes[0]
    return {"names": names, "w": w, "b": b + float(np.log(odds / drawn_odds)), "labels": found}


def score(docs: DataFrame, model: dict, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The key, the columns in `keep`, and score (0 to 1) of each row's whole text; a null text counts as empty and gets
    the score of a text without entries. Repeated rows are scored each, null keys stay, an empty table gives no rows."""
    inner = [F.col(c).alias(f"_{i}") for i, c in enumerate((key, *keep))]
    raw = docs.select(*inner, text_or_empty().alias("_text"))
    names, w, b = model["names"], model["w"], model["b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Entries(names)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                hits = [entries(t.as_py()) for t in part.column(part.num_columns - 1)]
                rows, cols = features(hits, len(names))
                z = b + np.bincount(rows, w[cols], len(hits)) if len(rows) else np.full(len(hits), b)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*part.schema.names[:-1], "score"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in raw.schema.fields[:-1]] + ["score double"])
    out = raw.mapInArrow(run, schema)
    for i, c in enumerate((key, *keep)):
        out = out.withColumnRenamed(f"_{i}", c)
    return out
