"""Operator 10: exact Jaccard join of word n-gram sets by multiple global orders.

Documents with the same set form a class; the join runs over classes. For sets of similarity t or more, the prefixes of
length n - ceil(t n) + 1 share a token under every global order of tokens. The three orders here all put frequent
tokens last, by a class of frequency, and differ in the hash that orders tokens inside a class.

1. One pass over the texts stores each row's class and set, the latter as 48-bit hashes. All tokens are counted in 2^26
   cells of the hash space, a table of fixed size, which gives the frequency classes; these only steer the order: any
   order is exact.
2. The prefix tokens under the first order are emitted. Most occur once; a bitmap of hash cells that hold two or
   more of them lets the others go before the shuffle. Of the classes that meet in a token, each is paired
   with two leaders, so a token shared by m classes gives less than 2 m pairs, and these are verified.
3. Their components are found. Classes that meet in a token of at most 32 classes and are not yet in the same component
   are paired in full: a link inside a component can change nothing. Classes that meet in a token of more are joined
   anew among themselves, see `dense_links`, with exact counts of their tokens.

Pairs are candidates only if their prefixes under the second and the third order meet as well; this is tested on the
prefixes alone, before any set moves. Sets move for classes in some pair only, which a bitmap of fixed size selects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchway.llm.common import Memo, Scratch, batches_of, forget, once, text_or_empty
from larchway.llm.components import connected_components

#: Bits of a token's hash that are stored and compared.
TOKEN_BITS = 48
CELL_BITS, RANGE_BITS = 26, 10
LOW_BITS = CELL_BITS - RANGE_BITS
#: The bitmap of cells in which prefix tokens meet has four cells a posting, within these bounds (128 MB at most).
MEET_BITS = (20, 30)
#: Tokens in which at most so many classes meet pair them all, at most 15.5 pairs a posting; more are joined by
#: `dense_links`, which lists every token of a member twice instead of the 1 - t of them in a prefix: that is as many
#: rows as m / 2 pairs a posting for m about 4 / (1 - t), 27 at 0.85 and 20 at 0.8.
LIGHT = 32
#: Bytes of an Arrow batch that Python gets. By rows alone, 10,000 sets or texts are some 20 MB, whose buffers, doubled as
#: they grow, stay with each executor's allocator.
BATCH = 2 << 20
#: Above the mean of cells and eight deviations: where the frequency classes 1, 2 and 3 begin.
STEPS = (8, 64, 512)
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall
_odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit values, one for each seed."""
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * _odd[1]
    h ^= h >> np.uint64(29)
    h *= _odd[3]
    return h ^ (h >> np.uint64(32))


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct n-grams of a text as sorted 64-bit hashes; with fewer words, the whole sequence as one."""
    memo = once("words", lambda: Memo(xxhash.xxh3_64_intdigest, 150_000))
    memo.trim()
    words = _words(text.encode("utf-8", "surrogatepass").lower())  # lowers A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    short = len(ids) < size
    n = 1 if short else len(ids) - size + 1
    h = np.full(n, len(ids) if short else 0, np.uint64)
    for k in range(min(size, len(ids))):
        h = (h ^ (h >> np.uint64(31))) * _odd[0] + ids[k : k + n]
    return np.unique(mix(h, 7))


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def packed(h: np.ndarray) -> bytes:
    """The upper 48 bits of sorted 64-bit hashes, six bytes each."""
    return np.ascontiguousarray((h >> np.uint64(64 - TOKEN_BITS)).view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8]).tobytes()


def unpacked(blob) -> np.ndarray:
    out = np.zeros((len(blob) * 8 // TOKEN_BITS, 8), np.uint8)
    out[:, : TOKEN_BITS // 8] = np.frombuffer(blob, np.uint8).reshape(-1, TOKEN_BITS // 8)
    return out.reshape(-1).view("<u8")


def survey(docs: DataFrame, key: str, size: int) -> DataFrame:
    """doc_id, class, n and tokens of each row; tokens only where the task has not met the class lately."""
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    h = shingles(text.as_py(), size)
                    c = class_of(h) if len(h) else None
                    rows.append((doc_id, c, len(h), None if c is None or c in seen else packed(h)))
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(c)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, class bigint, n int, tokens binary")


def ranges_of(values: np.ndarray, low: int, kind: str) -> tuple[list[int], list[bytes]]:
    """Sorted cell numbers by range: the ranges that have some, and the low bits of those in each."""
    values = np.sort(values)
    cuts = np.searchsorted(values, np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64) << np.uint64(low))
    part = (values & np.uint64((1 << low) - 1)).astype(kind)
    full = [r for r in range(1 << RANGE_BITS) if cuts[r] < cuts[r + 1]]
    return full, [part[cuts[r] : cuts[r + 1]].tobytes() for r in full]


def laid_out(parts: DataFrame, width: int) -> np.ndarray:
    """The blobs of `parts(range, blob)` at their ranges' places, `width` bytes each; zeros where a range has none.

    One job fetches them, 128 MB at most: a local iterator would run a job for each shuffle partition. Batches go as
    they are laid out, so that both don't stand whole in the driver.
    """
    batches = parts.toArrow().to_batches()
    out = np.zeros(width << RANGE_BITS, np.uint8)
    while batches:
        batch = batches.pop()
        for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out[at * width : (at + 1) * width] = np.frombuffer(blob.as_buffer(), np.uint8)
    return out


def cells_of(sets: DataFrame) -> DataFrame:
    """(range, cells): the low bits of the cells of a range's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            full, blobs = ranges_of(np.concatenate(held) >> np.uint64(TOKEN_BITS - CELL_BITS), LOW_BITS, "<u2")
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "cells"])

        for batch in batches:
            for blob in batch.column(0):
                held.append(unpacked(blob.as_buffer()))
                size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return sets.select("tokens").mapInArrow(run, "range int, cells binary")


def frequency_table(cells: DataFrame, total: int, spread: int) -> np.ndarray:
    """Two bits for each cell: its class of frequency. The counts of a range are added up in `spread` parts first."""
    mean = total / (1 << CELL_BITS)
    floor = mean + 8 * mean**0.5
    bounds = [floor + s for s in STEPS]

    def part(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << LOW_BITS, np.int64)
        for blob in table.column("cells"):
            counts += np.bincount(np.frombuffer(blob.as_buffer(), "<u2"), minlength=1 << LOW_BITS)
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    def whole(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table.column("counts"))
        code = np.searchsorted(bounds, counts, side="left").astype(np.uint8).reshape(-1, 4)
        packed = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
        return pa.table({"range": table.column("range")[:1], "codes": pa.array([packed.tobytes()], pa.binary())})

    parts = cells.withColumn("salt", F.pmod(F.xxhash64("cells"), F.lit(spread))).groupBy("range", "salt").applyInArrow(lambda _, t: part(t.select(["range", "cells"])), "range int, counts binary")
    return laid_out(parts.groupBy("range").applyInArrow(lambda _, t: whole(t), "range int, codes binary"), 1 << LOW_BITS - 2)


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each cell that holds an id of the one column `class`."""

    def whole(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << LOW_BITS, bool)
        bits[table.column("low").to_numpy()] = True
        return pa.table({"range": table.column("range")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    cell = F.shiftrightunsigned("class", 64 - CELL_BITS)
    cells = ids.select(F.shiftright(cell, LOW_BITS).cast("int").alias("range"), cell.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int").alias("low")).distinct()
    return laid_out(cells.groupBy("range").applyInArrow(lambda _, t: whole(t), "range int, bits binary"), 1 << LOW_BITS - 3)


def ordered(h: np.ndarray, table: np.ndarray, seed: int) -> np.ndarray:
    """Positions in a global order: frequency class first, then a hash."""
    cell = (h >> np.uint64(TOKEN_BITS - CELL_BITS)).astype(np.int64)
    code = (table[cell >> 2] >> ((cell & 3) << 1).astype(np.uint8) & 3).astype(np.uint64)
    return code << np.uint64(62) | mix(h, seed) >> np.uint64(2)


def prefix(h: np.ndarray, table: np.ndarray, seed: int, percent: int) -> np.ndarray:
    place = ordered(h, table, seed)
    p = prefix_length(len(h), percent)
    return np.argpartition(place, p - 1)[:p] if p < len(h) else np.arange(len(h))


def postings(sets: DataFrame, percent: int, table) -> DataFrame:
    """(token, class, n) of the prefix under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("words")  # texts aren't read again
        codes = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, first = batch.slice(at, 256), []
                for blob in part.column(2):
                    h = unpacked(blob.as_buffer())
                    first.append(h[prefix(h, codes, 1, percent)])
                owner, n = (np.repeat(part.column(i).to_numpy(), [len(t) for t in first]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(owner), pa.array(n)], names=["token", "class", "n"])

    return sets.select("class", "n", "tokens").mapInArrow(run, "token bigint, class bigint, n int")


def meeting(found: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit for each cell of the hash space that holds two or more postings, and the bits of a cell's number."""
    bits = min(max((4 * n).bit_length(), MEET_BITS[0]), MEET_BITS[1])
    low = bits - RANGE_BITS

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            full, blobs = ranges_of(np.concatenate(held), low, "<u4")
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "cells"])

        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(TOKEN_BITS - bits))
            size += len(held[-1])
            if size > 1_500_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    def whole(table: pa.Table) -> pa.Table:
        once_, twice = np.zeros(1 << low, bool), np.zeros(1 << low, bool)
        for blob in table.column("cells"):
            c = np.frombuffer(blob.as_buffer(), "<u4")
            twice[c[once_[c]]] = True
            twice[c[1:][c[1:] == c[:-1]]] = True
            once_[c] = True
        return pa.table({"range": table.column("range")[:1], "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    parts = found.select("token").mapInArrow(cells, "range int, cells binary").groupBy("range").applyInArrow(lambda _, t: whole(t), "range int, bits binary")
    return laid_out(parts, 1 << low - 3), bits


def only_meeting(found: DataFrame, meet, bits: int) -> DataFrame:
    """Postings whose cell holds another: all that share their token, and few that don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(meet.value, np.uint8)
        for batch in batches:
            cell = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(TOKEN_BITS - bits)).astype(np.int64)
            yield batch.filter(pa.array((table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)))

    return found.mapInArrow(run, found.schema)


def chosen_sets(sets: DataFrame, ids: DataFrame, columns: str, make) -> DataFrame:
    """class and `columns` of the classes in `ids(class)` and of a few others, whose bit in the bitmap is set too.

    make(blobs) gives the columns' values for a list of packed sets.
    """
    chosen = sets.sparkSession.sparkContext.broadcast(bitmap(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(chosen.value, np.uint8)
        for batch in batches:
            cell = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            part = batch.filter(pa.array((bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)))
            for at in range(0, len(part), 256):
                few = part.slice(at, 256)
                yield pa.RecordBatch.from_arrays([few.column(0), *make(few.column(1))], names=["class", *[c.split()[0] for c in columns.split(", ")]])

    return sets.select("class", "tokens").mapInArrow(run, f"class bigint, {columns}").dropDuplicates(["class"])


def orders_of(sets: DataFrame, ids: DataFrame, table, percent: int) -> DataFrame:
    """(class, second, third): prefixes under the second and third order, as 32-bit values."""

    def make(blobs: pa.Array) -> list[pa.Array]:
        codes, every = np.frombuffer(table.value, np.uint8), [unpacked(b.as_buffer()) for b in blobs]
        return [pa.array([(h[prefix(h, codes, seed, percent)] >> np.uint64(8)).astype(np.uint32).view(np.int32) for h in every], pa.list_(pa.int32())) for seed in (2, 3)]

    return chosen_sets(sets, ids, "second array<int>, third array<int>", make)


def as_arrays(sets: DataFrame) -> DataFrame:
    """(class, tokens) with the packed sets as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                few = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([unpacked(b.as_buffer()).view(np.int64) for b in few.column(1)], pa.list_(pa.int64()))], names=["class", "tokens"])

    return sets.select("class", "tokens").mapInArrow(run, "class bigint, tokens array<bigint>")


def similar(both: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of `both(a, b, a_tokens, b_tokens)` whose packed sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, table, percent: int, scratch: Scratch, tag: str) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under the second and third order and whose sets are similar enough."""
    ids = lambda df: df.select(F.col("a").alias("class")).union(df.select("b"))
    side = lambda df, s: df.select(*[F.col(c).alias(s if c == "class" else f"{s}_{c}") for c in df.columns])
    if pairs.isEmpty():
        return pairs.sparkSession.createDataFrame([], "a bigint, b bigint")
    orders = scratch.table(orders_of(sets, ids(pairs), table, percent), f"{tag}-orders")
    close = pairs.join(side(orders, "a"), "a").join(side(orders, "b"), "b").where(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third"))
    close = scratch.table(close.select("a", "b"), f"{tag}-close")
    scratch.drop(f"{tag}-orders")
    tokens = scratch.table(chosen_sets(sets, ids(close), "tokens binary", lambda blobs: [blobs]), f"{tag}-tokens")
    both = close.join(side(tokens, "a"), "a").join(side(tokens, "b"), "b")
    out = scratch.table(similar(both, percent), f"{tag}-links")
    scratch.drop(f"{tag}-tokens", f"{tag}-close")
    return out


def blocks(low: int, high: int) -> list[tuple[int, int]]:
    """The aligned blocks (level, number) of 2^level sizes that together are low..high."""
    out = []
    while low <= high:
        level = min((low & -low).bit_length() - 1 if low else 62, (high - low + 1).bit_length() - 1)
        out.append((level, low >> level))
        low += 1 << level
    return out


def local_postings(kept: DataFrame, percent: int) -> DataFrame:
    """The useful prefix tokens of `kept(class, component, n, useful)`, in exact order of frequency.

    `useful` holds (frequency, token) of the tokens that another component has too. The others can be in no
    intersection that matters; they stand first in the order and give no row. reach is the largest set that may still
    hold this token as the first one shared; bare is the share of the tokens that aren't useful, in millionths.
    """
    n, wide = F.col("n"), F.col("n").cast("long")  # products of an int overflow, which is an error
    least = F.ceil(percent * wide / 100).cast("int")
    bare = n - F.size("useful")
    first = F.slice(F.sort_array("useful"), F.lit(1), F.greatest(n - least + 1 - bare, F.lit(0)))
    each = kept.select("class", "component", "n", least.alias("least"), bare.alias("own"), F.posexplode(first).alias("at", "x"))
    reach = F.floor(((100 + percent) * (wide - F.col("own") - F.col("at")) - percent * wide) / percent).cast("int")
    return each.select("x.token", "class", "component", "n", reach.alias("reach"), F.floor(1_000_000 * F.col("own").cast("long") / n).cast("int").alias("bare"), "least").where("reach >= least").drop("least")


def by_size(local: DataFrame, percent: int, larger: bool) -> DataFrame:
    """Local postings with the blocks of sizes under which a pair's smaller set is listed and its larger one looks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, (n, reach) in enumerate(zip(batch.column("n").to_pylist(), batch.column("reach").to_pylist(), strict=True)):
                if larger:
                    found = blocks((percent * n + 99) // 100, min(n, reach))
                else:
                    found = [(level, n >> level) for level in range(((100 - percent) * n // percent + 2).bit_length())] if reach >= n else []
                keys += found
                rows += [i] * len(found)
            if rows:
                level, block = zip(*keys, strict=True)
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(level, pa.int32()), pa.array(block, pa.int32())], names=[*part.schema.names, "level", "block"])

    return local.select("token", "class", "component", "n", "reach").mapInArrow(run, "token bigint, class bigint, component bigint, n int, reach int, level int, block int")


def dense_links(members: DataFrame, sets: DataFrame, table, percent: int, scratch: Scratch) -> DataFrame:
    """The links (a, b) that matter among `members(class, component)`: classes that meet in crowded tokens.

    Only tokens found in two components count. Their exact frequencies among the members give the order, and a pair's own
    sizes the length of its prefixes, which is about half of what a single set must allow for. A member of a group of
    near copies that differs from the group's middle by too many tokens has none but its own tokens there, and meets
    nobody. Each token first pairs its members with the one nearest to the middle, the one with the least share of
    tokens of its own; then components are renewed, and what is still apart is paired, by blocks of sizes that are
    exactly those in reach, so that no set is compared with one outside.
    """
    # from here on only the members' sets are read, not all
    sets = scratch.table(chosen_sets(sets, members.select("class"), "tokens binary", lambda blobs: [blobs]).join(members.select("class"), "class"), "dense-packed")
    chosen = scratch.table(as_arrays(sets).join(members, "class"), "dense-sets")

    def postings_of(sets_: DataFrame, tag: str) -> DataFrame:
        each = sets_.select("class", "component", F.explode("tokens").alias("token"))
        useful = each.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("df")).where("low <> high").select("token", "df")
        useful = scratch.table(useful, f"dense-useful-{tag}")
        kept = each.select("class", "token").join(useful, "token").groupBy("class").agg(F.collect_list(F.struct("df", "token")).alias("useful"))
        kept = kept.join(sets_.select("class", "component", F.size("tokens").alias("n")), "class")
        return scratch.table(local_postings(kept, percent), f"dense-local-{tag}")

    local = postings_of(chosen, "stars")
    lead = local.groupBy("token").agg(F.min(F.struct("bare", "class", "component", "n", "reach")).alias("o"))
    lead = scratch.table(lead.select("token", *[F.col(f"o.{c}").alias(f"o_{c}") for c in ("class", "component", "n", "reach")]), "dense-lead")
    fits = (F.col("component") != F.col("o_component")) & (F.col("n") <= F.col("o_reach")) & (F.col("o_n") <= F.col("reach"))
    stars = local.join(lead, "token").where(fits).select(F.least("class", "o_class").alias("a"), F.greatest("class", "o_class").alias("b")).distinct()
    stars = scratch.table(stars, "dense-stars")
    links = verified(stars, sets, table, percent, scratch, "dense-stars")

    joined = links.select("a", "b").union(members.where("class <> component").select("class", "component"))
    renewed = connected_components(joined, scratch, "dense").withColumnsRenamed({"id": "class", "component": "now"})
    apart = scratch.table(chosen.join(renewed, "class", "left").select("class", F.coalesce("now", "component").alias("component"), "tokens"), "dense-apart")
    local = postings_of(apart, "pairs")
    small, large = scratch.table(by_size(local, percent, False), "dense-small"), scratch.table(by_size(local, percent, True), "dense-large")
    small = small.select("token", "level", "block", *[F.col(c).alias(f"o_{c}") for c in ("class", "component", "n", "reach")])
    earlier = F.struct("o_n", "o_class") < F.struct("n", "class")
    pairs = large.join(small, ["token", "level", "block"]).where(fits & earlier).select(F.least("class", "o_class").alias("a"), F.greatest("class", "o_class").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = verified(scratch.table(pairs, "dense-pairs"), sets, table, percent, scratch, "dense-pairs")
    scratch.drop("dense-packed", "dense-sets", "dense-apart", "dense-useful-stars", "dense-useful-pairs", "dense-local-stars", "dense-local-pairs", "dense-lead", "dense-small", "dense-large", "dense-stars", "dense-pairs")
    return links.union(more)


def jaccard_components(docs: DataFrame, key: str = "doc_id", size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `docs(key, text, ...)`; the rest of the columns is ignored.

    Rows link when 100 * |intersection| >= percent * |union| of their sets; the component is the smallest id that links
    reach. A null or empty text, or one without words, has an empty set and is its own component. Repeated rows are
    copies of each other like any two rows with one text. A row with a null id takes part; it is never a component's
    name unless nothing else is in it. An empty table gives no rows.
    """
    with batches_of(docs.sparkSession, BATCH):
        return _components(docs, key, size, percent)


def _components(docs: DataFrame, key: str, size: int, percent: int) -> DataFrame:
    """All Python runs in here, while the tables are written; what the result reads needs none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    surveyed = scratch.table(survey(docs, key, size), "survey")
    rows, sets = surveyed.select("doc_id", "class", "n"), surveyed.where("tokens IS NOT NULL").select("class", "n", "tokens")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    codes = frequency_table(cells_of(sets), total, 1 + total // (1 << 34))
    table = spark.sparkContext.broadcast(codes)

    every = scratch.table(postings(sets, percent, table), "postings")
    cells, bits = meeting(every, every.count())
    meet = spark.sparkContext.broadcast(cells)
    del cells  # up to 128 MB
    found = scratch.table(only_meeting(every, meet, bits).distinct(), "meeting")
    meet.destroy()
    scratch.drop("postings")
    in_reach = lambda n, m: 100 * F.least(n, m).cast("long") >= percent * F.greatest(n, m).cast("long")
    similar = in_reach("n", "m") & (F.col("class") != F.col("lead"))
    lead = found.groupBy("token").agg(F.min("class").alias("lead"), F.max("class").alias("last")).where("lead <> last")
    shared = scratch.table(found.join(lead, "token"), "shared")
    sizes = found.select(F.col("class").alias("lead"), F.col("n").alias("m")).distinct()
    ends = shared.select("class", "n", F.explode(F.array("lead", "last")).alias("lead")).distinct()
    stars = ends.join(sizes, "lead").where(similar).select(F.least("lead", "class").alias("a"), F.greatest("lead", "class").alias("b")).distinct()
    stars = scratch.table(stars, "stars")
    scratch.drop("meeting")
    links = verified(stars, sets, table, percent, scratch, "stars")
    near = connected_components(links, scratch, "near")

    labelled = scratch.table(shared.join(near.withColumnRenamed("id", "class"), "class", "left").select("token", "class", "n", F.coalesce("component", "class").alias("component")), "labelled")
    mixed = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("df")).where("low <> high").select("token", "df")
    mixed = scratch.table(mixed, "mixed")
    open_ = labelled.join(mixed.where(F.col("df") <= LIGHT), "token", "left_semi")
    other = open_.select("token", *[F.col(c).alias(f"o_{c}") for c in ("class", "n", "component")])
    pairs = open_.join(other, "token").where((F.col("component") < F.col("o_component")) & in_reach("n", "o_n"))
    pairs = pairs.select(F.least("class", "o_class").alias("a"), F.greatest("class", "o_class").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = verified(scratch.table(pairs, "pairs"), sets, table, percent, scratch, "pairs")
    crowd = labelled.join(mixed.where(F.col("df") > LIGHT), "token", "left_semi").groupBy("class").agg(F.first("component").alias("component"))
    crowd = scratch.table(crowd, "crowd")
    links = links.union(more)
    scratch.drop("stars", "shared", "labelled", "mixed", "pairs")
    if not crowd.isEmpty():
        links = links.union(dense_links(crowd, sets, table, percent, scratch))
    final = connected_components(links, scratch, "all")

    named = rows.join(final.withColumnRenamed("id", "class"), "class", "left").withColumn("group", F.coalesce("component", "class"))
    names = scratch.table(named.where("class IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("name")), "names")
    return named.join(names, "group", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))
