"""Operator 9: SentencePiece BPE encoding by backtracking, and decoding.

No piece holds a blank sign after another character and none holds a line feed, so a text's ids are those of its chunks
in order. A chunk is encoded once for each worker:

* Aho-Corasick gives all pieces that match, by start, longest first.
* From each position the longest piece is tried that is compatible with the piece before it: re-merging the two, best
  score first, gives the two. Pieces that don't merge to themselves are no candidates.
* Where none fits, the position's bit in a bitfield of failed positions is set and the piece before it is shortened;
  pieces ending at a failed position are never tried again, so the work is linear in the chunk.
* Characters in no piece never merge; they become byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchway.llm.common import Memo, once, text_or_empty

BLANK = "▁"
SCHEMA = "doc_id bigint, ids binary, decoded string"
ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


class PieceCodec:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.score = {pieces[i]: sp.get_score(i) for i in plain}
        self.id = {pieces[i]: i for i in plain}
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.begin, self.end = (np.uint32(i).tobytes() for i in (sp.bos_id(), sp.eos_id()))
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.id):
            raise ValueError("pieces of this model cross blanks or lines; its texts can't be cut there")
        if sp.encode(" a") != sp.encode(BLANK + "a") or sp.decode(sp.encode("a")) != "a" or len(self.byte_id) != 256:
            raise ValueError("only models with identity normalisation, a dummy prefix and byte pieces are read")
        self.pair = Memo(lambda two: self.merge([*two[0], *two[1]]) == [*two], 1 << 20)
        self.match = ahocorasick.Automaton()
        for p in self.id:
            if self.merge([*p]) == [p]:
                self.match.add_word(p, p)
        self.match.make_automaton()
        self.raw = {i: bytes([b]) for b, i in self.byte_id.items()} | {i: p.replace(BLANK, " ").encode() for p, i in self.id.items()} | {sp.bos_id(): b"", sp.eos_id(): b""}
        self.unknown = "⁇".join("  ").encode()
        self.chunks = re.compile(r" *[^ \n]+|\n| +").findall
        self.memo = Memo(self._chunk, 400_000)
        self.memo_mark = {m: np.uint32(self.id[m]).tobytes() for m in ".,;:" if m in self.id}
        self.last = {i: p for p, i in self.id.items()}

    def merge(self, parts: list[str]) -> list[str]:
        """Merges the adjacent two with the best score, the leftmost of equals, until none merge."""
        while len(parts) > 1:
            score, at = max((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if score == -np.inf:
                break
            parts = [*parts[:-at], parts[-at] + parts[1 - at], *parts[2 - at :]]
        return parts

    def _chunk(self, chunk: str) -> bytes:
        if chunk[-1] in ".,;:" and chunk[-2:-1].isalpha():  # the ids of the rest and the mark, where these don't merge
            rest, mark = self.memo[chunk[:-1]], chunk[-1]
            before = self.last.get(int.from_bytes(rest[-4:], "little"))
            if before and mark in self.id and self.pair[before, mark]:
                return rest + self.memo_mark[mark]
        return array("I", self.encode_chunk(chunk.replace(" ", BLANK))).tobytes()

    def encode_chunk(self, chunk: str) -> list[int]:
        n = len(chunk)
        at: list[list[str]] = [[] for _ in range(n)]  # by start, shortest first, as ends rise
        for last, piece in self.match.iter(chunk):
            at[last + 1 - len(piece)].append(piece)
        failed = bytearray(n // 8 + 1)
        taken: list[tuple[int, int, str]] = []  # start, how many longer candidates there are, piece
        pos = k = 0
        while pos < n:
            before = taken[-1][2] if taken else None
            candidates = at[pos] or [chunk[pos]]
            for k in range(len(candidates) - 1 - k, -1, -1):  # noqa: B020, PLR1704
                piece = candidates[k]
                stop = pos + len(piece)
                if not failed[stop >> 3] >> (stop & 7) & 1 and (before is None or self.pair[before, piece]):
                    taken.append((pos, len(candidates) - 1 - k, piece))
                    pos, k = stop, 0
                    break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos, k, _ = taken.pop()
                k += 1
        return [i for _, _, p in taken for i in ([self.id[p]] if p in self.id else [self.byte_id[b] for b in p.encode()])]

    def encode(self, text: str) -> bytes:
        """The ids with begin and end, as little-endian unsigned 32-bit integers. An empty text has these two alone."""
        self.memo.trim()
        self.pair.trim()
        body = b"".join(map(self.memo.__getitem__, self.chunks(" " + text.replace(BLANK, " ")))) if text else b""
        return self.begin + body + self.end

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        body = b"".join([raw[i] if i in raw else self.unknown for i in np.frombuffer(ids, "<u4").tolist()])
        return body.removeprefix(b" ").decode("utf-8", "replace")


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, begin and end included) and the decoded text of each row of
    `docs(doc_id, text, ...)`; other columns are ignored. A null text counts as empty: begin and end, decoded to an
    empty text. Repeated rows are encoded each; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(("pieces", model), lambda: PieceCodec(model))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)
