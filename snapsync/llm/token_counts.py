"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous merging of ragged arrays.

A batch of distinct pre-tokens is held as one flat array of symbol ids with a sequence number for each. In every round
all sequences find their own lowest-rank pair and merge all places of it at once; sequences without a known pair leave.
A pair that a merge makes has a later rank than the merge, so this gives what one merge at a time gives. The count of
a pre-token is the number of symbols that survive; counts are kept for the next batches, up to a fixed number.

Results for odd input: a null text counts as an empty one, with no bytes and no tokens; strings of special tokens
inside a text are one token each, as the vocabulary's library has it by default; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapsync.llm.common import mix64, slices

#: Fixed values of the byte-level pre-tokenizer: its pattern, and the white space that the library's regex engine knows.
_WS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Counts kept by a worker before it starts afresh.
KEPT = 300_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabularies of this kind: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


class RankMerger:
    """Counts the symbols that are left of byte strings once all merges are applied."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.symbol = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.symbol[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.last = len(keys)
        # Open addressing in arrays: slot -> pair, rank, merged symbol.
        self.bits = int(np.ceil(np.log2(max(16, 4 * len(keys)))))
        self.pair, self.rank, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.last, np.int32), np.zeros(1 << self.bits, np.int64)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.pair[slot[todo]] == -1
            first = todo[free][np.unique(slot[todo[free]], return_index=True)[1]]
            self.pair[slot[first]], self.rank[slot[first]], self.made[slot[first]] = keys[first], first, made[first]
            todo = np.setdiff1d(todo, first)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self._slot(keys)
        rank, made = np.full(len(keys), self.last, np.int32), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.pair[slot[open_]]
            hit = found == keys[open_]
            rank[open_[hit]], made[open_[hit]] = self.rank[slot[open_[hit]]], self.made[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return rank, made

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = lengths.copy()
        symbols = self.symbol[np.frombuffer(b"".join(tokens), np.uint8)]
        sequence = np.repeat(np.arange(len(tokens)), lengths)
        rank, made = self._pairs(symbols, sequence)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([np.ones(1, bool), sequence[1:] != sequence[:-1]]))
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(rank, starts)
            alive = lowest < self.last
            out[sequence[starts]] = sizes
            if not alive.any():
                break
            keep = np.repeat(alive, sizes)
            chosen = (rank == np.repeat(lowest, sizes)) & keep
            # Of overlapping places (a run of one symbol) every second one merges, from the left.
            at = np.flatnonzero(chosen)
            new_run = np.concatenate([np.ones(1, bool), at[1:] != at[:-1] + 1])
            head = np.flatnonzero(new_run)
            parity = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            at = at[parity % 2 == 0]
            symbols[at] = made[at]
            keep[at + 1] = False
            dirty = np.zeros(len(symbols), bool)
            dirty[at] = True
            symbols, sequence, rank, made, dirty = symbols[keep], sequence[keep], rank[keep], made[keep], dirty[keep]
            # Only pairs that a merge touched have other ranks now.
            dirty[:-1] |= dirty[1:]
            touched = np.flatnonzero(dirty)
            rank[touched], made[touched] = self._pairs(symbols, sequence, touched)
        return out

    def _pairs(self, symbols: np.ndarray, sequence: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(symbols)) if at is None else at
        rank, made = np.full(len(at), self.last, np.int32), np.zeros(len(at), np.int64)
        inner = np.flatnonzero(at < len(symbols) - 1)
        inner = inner[sequence[at[inner]] == sequence[at[inner] + 1]]
        rank[inner], made[inner] = self._ranks(symbols[at[inner]] * self.base + symbols[at[inner] + 1])
        return rank, made


class TextCounter:
    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.find = regex.compile(PATTERN).findall
        special = [s for s in self.merger.special if s]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        found, extra = [], []
        for text in texts:
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                found.append([t for part in parts for t in self.find(part)])
                extra.append(len(parts) - 1)
            else:
                found.append(self.find(text))
                extra.append(0)
        missing = list(set(filterfalse(self.known.__contains__, chain.from_iterable(found))))
        if len(self.known) + len(missing) > KEPT:
            self.known, missing = {}, list(set(chain.from_iterable(found)))
        if missing:
            self.known.update(zip(missing, self.merger.counts([t.encode("utf-8", "surrogatepass") for t in missing]).tolist()))
        get = self.known.__getitem__
        return [sum(map(get, tokens)) + more for tokens, more in zip(found, extra)]


_COUNTERS: dict[str, TextCounter] = {}


def _counter(path: str) -> TextCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TextCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs (columns doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                n = pa.array(counter.counts(part["text"].to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pc.cast(pc.binary_length(part["text"]), pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
