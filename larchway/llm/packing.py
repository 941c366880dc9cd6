"""Operator 1: hierarchical multi-length packing.

Each task packs the documents it reads; nothing is shuffled, and a lost task is packed again from its input alone.

* A document's ids are cut into whole windows of the longest tier; what remains is routed to the shortest tier that
  holds it (a remainder of 700 ids to the 1024 tier, one of 90 to the 128 tier).
* Tiers are packed from the longest: a window starts with the longest waiting remainder of its tier; its gap is filled
  with the longest remainders of shorter tiers that fit, and the last gap with a cut from the longest one left. Windows
  are therefore full, and a document is cut only where nothing whole fits.
* What is left at the end of a task goes into sequences whose lengths are powers of two, which need no padding.
* Sequences join step groups of about `group_tokens` ids, dealt so that groups have equal attention cost (sum of the
  squares of piece lengths) as well as equal ids.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchway.llm.byte_bpe import ByteBPE
from larchway.llm.common import once, text_or_empty

TIERS = (1024, 512, 256, 128)
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, step_group bigint"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("step_group", pa.int64())])
#: Bits of a sequence id below the number of the task.
LOCAL_BITS = 36


class Waiting:
    """Remainders by length; each is (doc, start, length)."""

    def __init__(self):
        self.keys: list[tuple[int, int]] = []
        self.items: dict[int, tuple] = {}
        self.n = self.tokens = 0

    def add(self, item: tuple) -> None:
        self.n += 1
        self.items[self.n] = item
        bisect.insort(self.keys, (item[2], self.n))
        self.tokens += item[2]

    def take(self, most: int) -> tuple | None:
        """The longest of at most that length."""
        at = bisect.bisect_right(self.keys, (most, 1 << 62)) - 1
        if at < 0:
            return None
        length, key = self.keys.pop(at)
        self.tokens -= length
        return self.items.pop(key)


class Packer:
    """Packs one task's documents. `put` may return sequences at any time; `finish` returns the rest."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = 1 << 20, group_tokens: int = 16_384):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
            raise ValueError("tiers are powers of two, longest first")
        self.tiers, self.buffer, self.group_tokens = tiers, buffer_tokens, group_tokens
        self.waiting, self.ready, self.groups = Waiting(), [], 0

    def put(self, doc: tuple, length: int) -> list:
        """doc: anything that names the document and its ids."""
        longest, start = self.tiers[0], 0
        while length - start >= longest:
            self.ready.append([(doc, start, longest)])
            start += longest
        if length > start:
            self.waiting.add((doc, start, length - start))
        if self.waiting.tokens >= self.buffer or len(self.ready) * longest >= self.buffer:
            self.pack(keep=self.buffer // 8)
            return self.dealt()
        return []

    def window(self, size: int, first: tuple | None) -> list:
        pieces, room = [], size
        while room:
            item = first or self.waiting.take(room)
            first = None
            if item is None:  # nothing whole fits: cut the longest
                doc, start, length = self.waiting.take(1 << 62)
                item = (doc, start, room)
                self.waiting.add((doc, start + room, length - room))
            pieces.append(item)
            room -= item[2]
        return pieces

    def pack(self, keep: int = 0) -> None:
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while self.waiting.tokens >= max(tier, keep) and self.waiting.keys[-1][0] > below:
                self.ready.append(self.window(tier, self.waiting.take(tier)))
        if not keep:
            for bit in range(self.tiers[0].bit_length() - 1, -1, -1):
                while self.waiting.tokens >= 1 << bit:
                    self.ready.append(self.window(1 << bit, None))

    def dealt(self) -> list:
        """(step group, pieces) of the packed sequences, dealt by falling cost to the group with the fewest ids and least cost."""
        total = sum(p[2] for s in self.ready for p in s)
        n = max(1, round(total / self.group_tokens))
        cost = lambda s: sum(p[2] ** 2 for p in s)
        heap = [(0, 0, self.groups + i) for i in range(n)]
        out = []
        for s in sorted(self.ready, key=lambda s: (-sum(p[2] for p in s), -cost(s))):
            tokens, paid, group = heapq.heappop(heap)
            out.append((group, s))
            heapq.heappush(heap, (tokens + sum(p[2] for p in s), paid + cost(s), group))
        self.groups += n
        self.ready = []
        return out

    def finish(self) -> list:
        self.pack()
        return self.dealt() if self.ready else []


def pack_documents(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = 0, buffer_tokens: int = 1 << 20, group_tokens: int = 16_384) -> DataFrame:
    """Packs `docs(doc_id, text, ...)` into sequences; a row for each piece of a document.

    ids holds the piece's ids as little-endian unsigned 32-bit integers; a document is its ids and then `end_id`.
    A null text counts as empty, so such a document is the single end id. Repeated rows are packed each on their own.
    A null doc_id stays null. Further columns of `docs` are ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(("byte_bpe", tokenizer), lambda: ByteBPE(tokenizer))
        end = np.uint32(end_id).tobytes()
        base = TaskContext.get().partitionId() << LOCAL_BITS
        packer, local = Packer(tiers, buffer_tokens, group_tokens), 0

        def rows(sequences: list) -> Iterator[pa.RecordBatch]:
            nonlocal local
            for at in range(0, len(sequences), 4096):
                cols: list[list] = [[] for _ in ARROW]
                for group, pieces in sequences[at : at + 4096]:
                    offset, used = 0, sum(p[2] for p in pieces)
                    for (doc_id, ids), start, length in pieces:
                        for c, v in zip(cols, (doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, base + local, offset, used, base + group), strict=True):
                            c.append(v)
                        offset += length
                    local += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py()) + end
                yield from rows(packer.put((doc_id, ids), len(ids) // 4))
        yield from rows(packer.finish())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)
