"""Operator 7: near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions alone.

Lines are compared as sequences of words; the edit bound is one word inserted, deleted or replaced. A line goes if an
earlier line, by (document, line number), is equal or, from eight words on, within the bound.

1. Equal lines are one class, named by two independent 64-bit hashes, with its earliest place.
2. An edit leaves the first or the last half of a line as it is. Classes that share neither with another class have no
   neighbours and go no further; the words of the others are fetched from the texts.
3. Each of those emits the hash of the whole line and of every line with one word deleted, outside the half it shares.
   Two lines are within the bound exactly if one, whole, equals the other with a word deleted, or both are equal without
   the word at the same place. Keys of a single line go; of the others the earliest place is aggregated, before and
   after the shuffle, and joined back. No pairs are listed, so a key of many lines costs a row for each.
4. The earliest neighbour found is verified on the words themselves.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchway.llm.common import Scratch, text_or_empty

#: The characters that separate words besides the space: tab, vertical tab, form feed, carriage return.
OTHER_SPACES = "\t\x0b\x0c\r"
#: Lines of fewer words have no near copies, only equal ones: one edit would be a large part of them.
LEAST_WORDS = 8


def words_of(line: Column) -> Column:
    """The words of a line in which only spaces separate them. A split at a single character needs no regular expression."""
    return F.array_remove(F.split(line, " "), "")


def plain(text: Column) -> Column:
    """A text whose words are separated by spaces and line feeds alone; of the same lines."""
    return F.when(reduce(or_, [F.contains(text, F.lit(c)) for c in OTHER_SPACES]), F.translate(text, OTHER_SPACES, " " * len(OTHER_SPACES))).otherwise(text)


def two_hashes(words: Column) -> list[Column]:
    return [F.xxhash64(words), F.xxhash64(F.lit(17), words)]


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def variant_hashes(words: Column, from_: Column, to: Column) -> Column:
    """(gone, k): the hash of the whole line, as gone 0, and of the line without its i-th word, for i > from_ or i <= to.

    The line becomes a byte string of its words' hashes, which is hashed in chunks of about the root of its length; a
    line's hash is the exclusive-or of its chunks' hashes with their numbers. Without a word, chunks before it are as
    they were, and those after it are the chunks that begin a word later; both kinds are hashed once a line. So a
    variant costs the root of the length, and a line its length to the power 1.5.
    """
    n = F.size(words)
    span = lambda m: F.floor(F.sqrt(F.greatest(m, F.lit(1)))).cast("int")
    xor = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    last = lambda m, c: F.floor((m - 1) / c).cast("int")
    chunks = lambda b, shift, c, m: F.transform(F.sequence(F.lit(0), last(m, c)), lambda j: F.xxhash64(F.substring(b, 8 * (j * c + shift) + 1, 8 * c), j))
    places = F.filter(F.sequence(F.lit(1), n), lambda i: (i > from_) | (i <= to))

    def around(x: Column) -> Column:
        """The exclusive-or of the chunks before, and of those after, each."""
        every = F.sequence(F.lit(0), F.size(x["before"]) - 1)
        return F.struct(
            x["b"].alias("b"),
            x["c"].alias("c"),
            F.transform(every, lambda j: xor(F.slice(x["before"], F.lit(1), j))).alias("before"),
            F.transform(every, lambda j: xor(F.slice(x["after"], j + 2, F.size(x["after"]) - j - 1))).alias("after"),
        )

    def without(x: Column) -> Column:
        b, c = x["b"], x["c"]

        def one(i: Column) -> Column:
            j = F.least(F.floor((i - 1) / c).cast("int"), F.size(x["before"]) - 1)
            middle = F.concat(F.substring(b, 8 * j * c + 1, 8 * (i - 1 - j * c)), F.substring(b, 8 * i + 1, 8 * ((j + 1) * c - i + 1)))
            k = F.element_at(x["before"], j + 1).bitwiseXOR(F.xxhash64(middle, j)).bitwiseXOR(F.element_at(x["after"], j + 1))
            return F.struct(i.alias("gone"), k.alias("k"))

        return F.transform(places, one)

    def of(b: Column) -> Column:
        whole = xor(chunks(b, 0, span(n), n))
        parts = F.struct(b.alias("b"), span(n - 1).alias("c"), chunks(b, 0, span(n - 1), n - 1).alias("before"), chunks(b, 1, span(n - 1), n - 1).alias("after"))
        return F.concat(F.array(F.struct(F.lit(0).alias("gone"), whole.alias("k"))), let(let(parts, around), without))

    digits = F.transform(words, lambda w: F.lpad(F.hex(F.xxhash64(w)), 16, "0"))
    return let(F.unhex(F.array_join(digits, "")), of)


def identity(key: str, text: str) -> list[Column]:
    """doc and version: what tells documents apart. Rows with the same id and text are one document; a null id counts as the smallest."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("version")]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, version, line_no, words) of all lines.

    Words are split before the lines are exploded: a filter on them can't move below and split every line again.
    """
    each = docs.select(*identity(key, text), plain(text_or_empty(text)).alias("plain"))  # a text is hashed once, not once a line
    return each.select("doc", "version", F.posexplode(F.transform(F.split("plain", "\n"), words_of)).alias("line_no", "words"))


def _block_keys(words: Column, n: Column) -> Column:
    """(key, side): hashes of the first and last L words, where L, a power of two from 4 to 64, is a quarter to half of
    the line; at least one survives an edit. Two neighbours may have different L where a length is 16, 32, 64 or 128:
    there the L of the shorter one is given as well. side is L for the first words, -L for the last."""
    ends = lambda b: [F.struct(F.xxhash64(F.lit(b), F.slice(words, 1, b)).alias("key"), F.lit(b).alias("side")), F.struct(F.xxhash64(F.lit(-b), F.slice(words, -b, b)).alias("key"), F.lit(-b).alias("side"))]
    out = F.when(n < 16, F.array(*ends(4)))
    for b in (8, 16, 32, 64):
        out = out.when(n == 2 * b, F.array(*ends(b), *ends(b // 2)))
        out = out.when((n < 4 * b) | F.lit(b == 64), F.array(*ends(b)))
    return out


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, scratch: Scratch | None = None, least_equal: int = 1) -> DataFrame:
    """(doc, version, line_no) of the lines that an earlier line makes redundant."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    place = F.struct("doc", "version", "line_no")
    lines = _lines(docs, key, text).withColumn("n", F.size("words")).where(F.col("n") >= min(least_words, least_equal))
    h1, h2 = two_hashes(F.col("words"))
    blocks = F.when(F.col("n") >= least_words, _block_keys(F.col("words"), F.col("n")))
    lines = scratch.table(lines.select("doc", "version", "line_no", h1.alias("h1"), h2.alias("h2"), blocks.alias("blocks"), (F.col("n") >= least_equal).alias("equal")), "lines")

    classes = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("blocks").alias("blocks"))
    classes = scratch.table(classes.select("h1", "h2", "first", (F.col("first") < F.col("last")).alias("again"), "blocks"), "classes")
    blocks = classes.where("blocks IS NOT NULL").select("h1", "h2", "first", F.explode("blocks").alias("b")).select("h1", "h2", "first", "b.*")
    busy = blocks.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    near = blocks.join(busy, "key", "left_semi").groupBy("h1", "h2").agg(F.min("first").alias("first"), F.min(F.when(F.col("side") > 0, F.col("side"))).alias("head"), F.max(F.when(F.col("side") < 0, F.col("side"))).alias("tail"))
    near = scratch.table(near.select("h1", "h2", "first.*", "head", "tail"), "near")

    wanted = near.groupBy("doc", "version").agg(F.collect_list(F.struct("line_no", "h1", "h2", "head", "tail")).alias("wanted"))
    found = docs.select(*identity(key, text), F.col(text).alias("text")).join(wanted, ["doc", "version"])
    found = found.select("doc", "version", F.split(plain(F.col("text")), "\n").alias("all"), "wanted")
    # words are split before the explode, as in _lines: the filter on their hashes would split them again, twice
    with_words = F.transform("wanted", lambda w: w.withField("words", words_of(F.element_at("all", w["line_no"] + 1))))
    found = found.select("doc", "version", F.explode(with_words).alias("w")).select("doc", "version", "w.*")
    w1, w2 = two_hashes(F.col("words"))
    texts = scratch.table(found.where((w1 == F.col("h1")) & (w2 == F.col("h2"))).select("h1", "h2", place.alias("first"), "words", "head", "tail").dropDuplicates(["h1", "h2"]), "texts")

    # an edit spares one half at least; where that's the first, the deleted word is behind it, and the other way round
    from_, to = F.coalesce("head", F.size("words")), F.coalesce(F.size("words") + F.col("tail"), F.lit(0))
    variants = texts.select("h1", F.explode(variant_hashes(F.col("words"), from_, to)).alias("v"))
    variants = scratch.table(variants.select("h1", "v.*"), "variants")
    met = variants.groupBy("k").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("k")
    hits = scratch.table(variants.join(met, "k", "left_semi"), "hits")
    scratch.drop("near", "variants")
    hits = hits.join(texts.select("h1", "h2", "first"), "h1")

    least = scratch.table(hits.groupBy("k", "gone").agg(F.min("first").alias("least")), "least")
    whole, cut = least.where("gone = 0").drop("gone"), least.where("gone > 0")
    shorter = hits.where("gone > 0").join(whole, "k")
    longer = hits.where("gone = 0").join(cut.groupBy("k").agg(F.min("least").alias("least")), "k")
    same = hits.where("gone > 0").join(cut, ["k", "gone"])
    sides = [d.where(F.col("least") < F.col("first")).select("h1", "h2", "least") for d in (shorter, longer, same)]
    witness = sides[0].union(sides[1]).union(sides[2]).groupBy("h1", "h2").agg(F.min("least").alias("least"))

    other = texts.select(F.col("first").alias("least"), F.col("words").alias("o"))
    pairs = witness.join(texts, ["h1", "h2"]).join(other, "least").withColumn("d", F.size("words") - F.size("o"))
    # words that both lines start with; zip_with fills the shorter one up with nulls
    differs = F.array_position(F.zip_with("words", "o", lambda a, b: a.eqNullSafe(b)), False).cast("int")
    pairs = pairs.withColumn("p", F.when(differs > 0, differs - 1).otherwise(F.size("words")))
    rest = lambda c, skip: F.slice(c, F.col("p") + 1 + skip, F.greatest(F.size(c) - F.col("p") - skip, F.lit(0)))
    within = ((F.col("d") == 0) & (rest("words", 1) == rest("o", 1))) | ((F.col("d") == 1) & (rest("words", 1) == rest("o", 0))) | ((F.col("d") == -1) & (rest("words", 0) == rest("o", 1)))
    verified = scratch.table(pairs.where(within).select("h1", "h2", F.lit(True).alias("near")), "verified")
    scratch.drop("texts", "hits", "least")

    # classes of one line that isn't near stay out; what is left is a table, so that a common line's rows can be dealt to many tasks
    places = classes.select("h1", "h2", "first", "again").join(verified, ["h1", "h2"], "left").where("again OR near").select("h1", "h2", "first", "near")
    places = scratch.table(places, "places")
    go = lines.join(places, ["h1", "h2"]).where((F.col("equal") & (F.col("first") < place)) | F.coalesce("near", F.lit(False)))
    return go.select("doc", "version", "line_no")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_equal: int = 1) -> DataFrame:
    """`docs` with its redundant lines taken out of `text`, and `_n_lines`, `_n_removed`.

    Lines end at line feeds. A line of `least_equal` words or more goes if an earlier one has the same words, one of
    `least_words` or more also if an earlier one is near; a line without words stays. The earliest line stays, whether
    or not it is near a still earlier one's neighbour: near is any earlier line within one word of it. A null text stays
    null. Rows with the same id and text are one document and lose the same lines; rows that share an id, or have none,
    and differ in text are documents of their own, in the order of their texts' hashes, a null id before all others. A
    line of n words takes n^1.5 steps, so a single line of a million words takes seconds. Other columns are kept,
    whatever their names. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = removed_lines(docs, key, text, least_words, scratch, least_equal)
    gone = scratch.table(gone.groupBy("doc", "version").agg(F.collect_set("line_no").alias("_gone")).withColumnsRenamed({"doc": "_doc", "version": "_version"}), "gone")
    scratch.drop("lines", "classes", "verified", "places")
    doc, version = identity(key, text)
    joined = docs.join(gone, (doc == F.col("_doc")) & (version == F.col("_version")), "left").drop("_doc", "_version")
    # only texts that lose a line are split; the numbers gone are distinct and of lines that are there
    n_lines = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    kept = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("_gone", i))
    out = joined.withColumns({"_n_lines": F.coalesce(n_lines, F.lit(0)).cast("long"), "_n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")})
    return out.withColumn(text, F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text))).drop("_gone")
