"""Operator 2: token counts by a compiled finite-state transducer.

The vocabulary (byte-level BPE with word ends, text lower-cased, white space dropped) is compiled, as far as the text
needs it, into a deterministic transducer whose transitions carry the number of tokens they emit:

* A state of the BPE part is what the future of a word depends on: the longest suffix of what was read that is a proper
  prefix of some token, and for each position in it the last token of the encoding up to there with its count, relative
  to the current one. Reading a byte, the new last token is the one candidate ending here that is compatible with the
  last token at its start, that is, re-merging the two gives the two. The emission is the change of the count.
* The last byte of a word is another symbol (it carries the word end), so the transducer keeps one byte back. The
  split part (letters, single digits, other characters, contractions) has seven states and decides where words end.
* White space leads from any state to the start. A text is cut there into chunks; the state map of such a chunk is
  constant, so composing the maps of a batch's chunks is one prefix sum of their counts, and a text's count is the
  difference of the scan at its two ends. Longer runs without white space are cut every CHUNK characters; such a
  chunk's map (state before -> state after, tokens emitted) is filled for the states it is entered from, as the states
  themselves are compiled only when met, and the maps of a run are composed in order.

Maps are memoised, and so are transitions; both tables are emptied, never truncated, when they outgrow their bounds.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchway.llm.byte_bpe import byte_alphabet
from larchway.llm.common import Memo, once, text_or_empty

CHUNK = 256
#: States of the split part: before a word, in letters, in other characters, after an apostrophe that begins a word, and
#: after such an apostrophe and r, v or l.
BEFORE, LETTERS, OTHER, APOSTROPHE, APOSTROPHE_R, APOSTROPHE_V, APOSTROPHE_L = range(7)
#: The contractions of this family of vocabularies.
SHORT, LONG = "stmd", {"r": ("e", APOSTROPHE_R), "v": ("e", APOSTROPHE_V), "l": ("l", APOSTROPHE_L)}
HELD = {APOSTROPHE_R: ("r", "e"), APOSTROPHE_V: ("v", "e"), APOSTROPHE_L: ("l", "l")}
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class Transducer:
    def __init__(self, path: str, most_states: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = set(model["vocab"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.symbol = byte_alphabet()
        self.prefixes = {""}
        for t in self.vocab:
            core = t.removesuffix(self.end)
            self.prefixes.update(core[:k] for k in range(1, len(core)))
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.most_states = most_states
        self.own = Memo(self._own, 1 << 20)
        self.pair = Memo(self._pair, 1 << 20)
        self.kind = Memo(lambda c: LETTERS if regex.match(r"\p{L}", c) else BEFORE if regex.match(r"\p{N}", c) else OTHER, 1 << 20)
        self.bytes = Memo(lambda c: [self.symbol[b] for b in c.encode()], 1 << 20)
        self.words = Memo(self._word, 300_000)
        self.maps = Memo(lambda key: self.run(*key), 20_000)
        self.reset()

    def reset(self) -> None:
        """Forgets compiled states; the start is state 0."""
        start = ("", ((None, 0),))
        self.states, self.index, self.arcs, self.ends = [start], {start: 0}, [{}], [{}]
        self.maps.clear()

    def numbered(self, key: tuple) -> int:
        """The number of a state, a new one if need be."""
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
            self.arcs.append({})
            self.ends.append({})
        return to

    def symbols(self, token: str) -> list[str]:
        core = token.removesuffix(self.end)
        out = list(core)
        if core != token:
            out[-1] += self.end
        return out

    def merge(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def _own(self, token: str) -> bool:
        return self.merge(self.symbols(token)) == [token]

    def _pair(self, two: tuple[str, str]) -> bool:
        return self.merge([*self.symbols(two[0]), *self.symbols(two[1])]) == [*two]

    def arc(self, state: int, symbol: str, last: bool) -> tuple[int, int]:
        """The next state and the tokens emitted; compiled on first use."""
        arcs = (self.ends if last else self.arcs)[state]
        if symbol in arcs:
            return arcs[symbol]
        window, tails = self.states[state]
        read = window + symbol
        for size in range(len(read), 0, -1):
            token = read[-size:] + self.end * last
            before, count = tails[len(read) - size]
            if token in self.vocab and self.own[token] and (before is None or self.pair[before, token]):
                break
        else:
            raise ValueError(f"no token ends after {read!r}")
        count += 1
        if last:
            to = 0
        else:
            grown = [*tails, (token, count)]
            keep = next(k for k in range(len(read), -1, -1) if read[len(read) - k :] in self.prefixes)
            key = (read[len(read) - keep :], tuple((t, n - count) for t, n in grown[len(grown) - keep - 1 :]))
            to = self.numbered(key)
        arcs[symbol] = to, count
        return to, count

    def run(self, entry: tuple, chunk: str) -> tuple[tuple, int]:
        """From (split state, BPE state, byte kept back) over a chunk without white space: the state after it, tokens emitted."""
        mode, state, kept = entry
        total = 0

        def feed(symbols: list[str]) -> None:
            nonlocal state, kept, total
            for s in symbols:
                if kept:
                    state, n = self.arc(state, kept, False)
                    total += n
                kept = s

        def close() -> None:
            nonlocal state, kept, total
            if kept:
                state, n = self.arc(state, kept, True)
                total += n
            kept = ""

        for c in chunk:
            kind = self.kind[c]
            if mode in HELD:
                held, second = HELD[mode]
                if c == second:
                    feed([held, second])
                    close()
                    mode = BEFORE
                    continue
                close()
                feed([held])
                mode = LETTERS
            elif mode == APOSTROPHE:
                if c in SHORT:
                    feed(self.bytes[c])
                    close()
                    mode = BEFORE
                    continue
                if c in LONG:
                    mode = LONG[c][1]
                    continue
                if kind != OTHER:
                    close()
                    mode = BEFORE
                else:
                    mode = OTHER
            if kind != mode or kind == BEFORE:
                close()
            if kind == OTHER:
                mode = APOSTROPHE if c == "'" and mode != OTHER else OTHER
            else:
                mode = kind
            feed(self.bytes[c])
            if kind == BEFORE:
                close()
        return (mode, state, kept), total

    def letters(self, word: str) -> int:
        """A word of letters alone, from the start to its end."""
        state, total, arcs = 0, 0, self.arcs
        symbols = word if word.isascii() else [s for c in word for s in self.bytes[c]]
        for s in symbols[:-1]:
            state, n = arcs[state].get(s) or self.arc(state, s, False)
            total += n
        return total + self.arc(state, symbols[-1], True)[1]

    def finish(self, at: tuple) -> int:
        """Tokens emitted by the white space, or end, that follows."""
        mode, state, kept = at
        if mode in HELD:
            return self.arc(state, kept, True)[1] + self.arc(0, HELD[mode][0], True)[1]
        return self.arc(state, kept, True)[1] if kept else 0

    def _word(self, word: str) -> int:
        if len(self.states) > self.most_states:
            self.reset()
        if len(word) <= CHUNK:
            if word.isalpha():
                return self.letters(word)
            if word[-1] in ".,;:" and word[:-1].isalpha():
                return self.words[word[:-1]] + self.words[word[-1]]
        at, total = (BEFORE, 0, ""), 0
        if len(word) <= CHUNK:
            at, total = self.run(at, word)
            return total + self.finish(at)
        for k in range(0, len(word), CHUNK):
            if len(self.states) > self.most_states:
                mode, state, kept = at
                key = self.states[state]
                self.reset()
                at = mode, self.numbered(key), kept
            self.maps.trim()
            at, n = self.maps[at, word[k : k + CHUNK]]
            total += n
        return total + self.finish(at)

    def chunks(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [w for w in BLANK.split(text) if w] if ODD.search(text) else text.split()

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. Special strings are cut out first and count one each."""
        maps: list[np.ndarray] = []
        ends, extra, done = np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts), np.int64), 0
        for i, text in enumerate(texts):
            self.words.trim()
            self.pair.trim()
            parts = self.special.split(text) if "<|" in text else [text]
            extra[i] = len(parts) // 2
            words = [w for part in parts[::2] for w in self.chunks(part)]
            maps.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
            done += len(words)
            ends[i + 1] = done
        scan = np.concatenate([[0], np.cumsum(np.concatenate(maps) if maps else np.zeros(0, np.int64))])
        return scan[ends[1:]] - scan[ends[:-1]] + extra


#: Separators that str.split() takes but Unicode White_Space doesn't hold.
ODD = re.compile("[\x1c-\x1f]")
BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row of `docs(doc_id, text, ...)`; other columns are ignored.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = once(("transducer", tokenizer), lambda: Transducer(tokenizer))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(machine.counts(part.column(1).to_pylist()))], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes")).mapInArrow(run, SCHEMA)
