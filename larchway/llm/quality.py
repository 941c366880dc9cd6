"""Operator 8: a ledger of rule bits.

One pass measures every text; each rule is then evaluated once, from the measurements, and its failure stored as a bit
beside them. Policies are versioned masks over the bits: applying another version, or asking what a policy would keep
without one of its rules, reads the ledger alone and never a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchway.llm.common import WORD, text_or_empty

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_twin_words", "n_upper")
SYMBOLS = "#*$%&|<>"


def rules() -> list[tuple[str, Column]]:
    """(name, fails) in the order of their bits. A new rule takes the next bit; bits are never used again."""
    c = F.col
    return [
        ("too_few_words", c("n_words") < 50),
        ("repeated_words", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("words_too_short", c("word_chars") < 2 * c("n_words")),
        ("words_too_long", c("word_chars") > 20 * c("n_words")),
        ("duplicate_lines", 2 * c("n_dup_lines") > c("n_lines")),
        ("capitals", 2 * c("n_upper") > c("word_chars")),
        ("twin_words", 5 * c("n_twin_words") > c("n_words")),
    ]


#: Version to the rules that reject. Versions are added, never changed.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "words_too_short", "words_too_long", "duplicate_lines", "capitals", "twin_words"),
}


def mask_of(policy: str) -> int:
    names = [n for n, _ in rules()]
    return sum(1 << names.index(n) for n in POLICIES[policy])


_words = re.compile(WORD).findall
_capitals = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]").findall


def measure(text: str) -> tuple[int, ...]:
    words = _words(text)
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    twins, repeated = int((ids[1:] == ids[:-1]).sum()), 0
    if n > 3:
        pairs = ids[:-1] * len(numbers) + ids[1:]
        if len(numbers) >= 1 << 20:  # else the product of three would not fit
            pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        windows = pairs[:-1] * len(numbers) + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(n, bool)
        for at in (order[1:][same], order[:-1][same]):
            for k in range(3):
                twice[at + k] = True
        repeated = int(twice.sum())
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated, twins, len(_capitals(text))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            table = np.array([measure(t.as_py()) for t in part.column(part.num_columns - 1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, table.T)], names=[*part.schema.names[:-1], *MEASURES])


def ledger(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The key, the columns in `keep`, the measurements and `failed`, a bit for each rule that the text fails.

    A null text has no words, like an empty one, and fails too_few_words. Words are runs between the six ASCII
    separators; texts are measured whole. Repeated rows and null keys stay rows of their own; columns of `docs` with
    the names of measurements clash with nothing unless they are kept. An empty table gives an empty ledger.
    """
    inner = [F.col(c).alias(f"_{i}") for i, c in enumerate((key, *keep))]
    raw = docs.select(*inner, text_or_empty().alias("_text"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in raw.schema.fields[:-1]] + [f"{m} bigint" for m in MEASURES])
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(rules())]
    out = raw.mapInArrow(_measured, schema).withColumn("failed", sum(bits, F.lit(0)).cast("long"))
    for i, c in enumerate((key, *keep)):
        out = out.withColumnRenamed(f"_{i}", c)
    return out


def apply_policy(kept_ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with `kept`: no rule of the policy's mask failed."""
    return kept_ledger.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablations(kept_ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail it alone (kept without it), and rows kept with all rules.

    One aggregation over distinct bit patterns, of which there are at most two to the number of rules.
    """
    mask = mask_of(policy)
    patterns = kept_ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = [(i, n) for i, (n, _) in enumerate(rules()) if mask >> i & 1]
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, n in names])).alias("r")
    out = patterns.select("bits", "n", rule).groupBy(F.col("r.rule").alias("rule"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return out.agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
    )
