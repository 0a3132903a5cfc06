"""Alignment of the tokens that two tokenizers give for one text, by anchors at white space.

A text is tokenised in full by both libraries. Where an A token and a B token end at one byte and the next tokens of
both begin with a space, the text is cut: between two such anchors lies a window, a pair of tuples of token ids. What a
window's tokens share (groups between common ends, links of overlapping ranges) depends on its ids alone, so it is
worked out once for each window met and remembered. Bytes are verified first: joined tokens of both kinds must give the
text back.

The libraries see each stretch between spaces once: no A pre-token and no B piece reaches over a cut before a single
space that a non-space follows (checked for the vocabulary when it is loaded), so the ids are those of the whole text.

Counts of id pairs over all documents are a Spark aggregation. They are broadcast to the documents' links if they are
at most BROADCAST rows, else joined.

Results for odd input: null and empty texts, and texts whose joined tokens differ from space and text, have no tokens:
zeros and an empty groups_sha256; rows are documents of their own, whatever their doc_id; further columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapsync.llm.common import slices, written
from snapsync.llm.token_counts import _WS, _byte_letters

#: Rows of pair counts that are broadcast at most.
BROADCAST = 2_000_000
#: Stretches and windows that a worker remembers before it starts afresh; longer stretches aren't remembered.
KEPT, LONGEST = 250_000, 200
#: Between a character that is no space and a single space that a character other than white space follows.
_CUT = regex.compile(rf"(?<! )(?= [^{_WS}])")

#: Where a space is no such place, but for spaces at the ends of a text.
_ODD = regex.compile(rf" [{_WS}]")
#: No id; stands between the packed ids of A and B that name a window.
_BETWEEN = array("i", [-1]).tobytes()


class Kept(dict):
    """A memory of so many entries: when it is full, only what is asked for again stays."""

    def __init__(self):
        super().__init__()
        self.before: dict = {}

    def make_room(self) -> None:
        if len(self) > KEPT:
            self.before = dict(self)
            self.clear()

    def __missing__(self, key):
        value = self[key] = self.before[key]
        return value


class Pair:
    """Both tokenizers, the bytes of their tokens, and what is remembered of stretches and windows."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(" " in p.replace("▁", " ").lstrip(" ") for p in pieces):
            raise ValueError(f"{path_b} has pieces that reach over a space")
        self.flat_a, self.start_a, self.size_a, self.space_a = self._table(self.bytes_a)
        self.flat_b, self.start_b, self.size_b, self.space_b = self._table(self.bytes_b)
        self.lengths_a, self.lengths_b = self.size_a.tolist(), self.size_b.tolist()
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.stretches, self.windows = Kept(), Kept()

    @staticmethod
    def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array([x[:1] == b" " for x in tokens], bool)

    @staticmethod
    def _stretches(text: str) -> list[str]:
        """A text cut at _CUT, without the space that each stretch (and the text) is led by."""
        if text[:1] == " " or text[-1:] == " " or _ODD.search(text):
            return [s[1:] for s in _CUT.split(" " + text) if s]
        return text.split(" ")

    def tokens(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """All ids of each text, A and B, as packed 32-bit numbers."""
        cut = [self._stretches(t) for t in texts]
        self.stretches.make_room()
        held = self.stretches
        new = [s for s in set(chain.from_iterable(cut)).difference(held) if s not in held.before]
        # A is given the space before a stretch; B adds it itself.
        a = self.a.encode_batch_fast([" " + s for s in new], add_special_tokens=False)
        b = self.b.encode(new, num_threads=1)
        held.update((s, (array("i", x.ids).tobytes(), array("i", y).tobytes())) for s, x, y in zip(new, a, b))
        out = []
        for parts in cut:
            ids = list(map(held.__getitem__, parts))
            out.append((b"".join([x[0] for x in ids]), b"".join([x[1] for x in ids])))
        for s in new:
            if len(s) > LONGEST:
                del held[s]
        return out

    def _align(self, packed_a: bytes, packed_b: bytes) -> tuple[bytes, bytes]:
        """Groups of a window as text, and its links as packed numbers a * size of B + b."""
        a, b = array("i", packed_a), array("i", packed_b)
        count_b, len_a, len_b, name = len(self.bytes_b), self.lengths_a, self.lengths_b, self.names
        groups, links, i, j, from_a, from_b, x, y, n = [], [], 0, 0, 0, 0, len_a[a[0]], len_b[b[0]], len(a)
        while True:
            links.append(a[i] * count_b + b[j])
            if x < y:
                i += 1
                x += len_a[a[i]]
            elif y < x:
                j += 1
                y += len_b[b[j]]
            else:
                i, j = i + 1, j + 1
                left = name[a[from_a]] if i - from_a == 1 else ",".join([name[k] for k in a[from_a:i]])
                groups.append(f"{left}|{name[b[from_b]] if j - from_b == 1 else ','.join([name[k] for k in b[from_b:j]])}")
                if i == n:
                    break
                from_a, from_b, x, y = i, j, x + len_a[a[i]], y + len_b[b[j]]
        return ";".join(groups).encode(), array("q", links).tobytes()

    @staticmethod
    def _spelt(ids: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
        """The joined bytes of tokens."""
        lengths = size[ids]
        ends = np.cumsum(lengths)
        return flat[np.repeat(start[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def documents(self, texts: list[str]) -> Iterator[tuple]:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of each text."""
        self.windows.make_room()
        for text, (packed_a, packed_b) in zip(texts, self.tokens(texts)):
            a, b = np.frombuffer(packed_a, np.int32), np.frombuffer(packed_b, np.int32)
            whole = b" " + text.encode()
            if not text or self._spelt(a, self.flat_a, self.start_a, self.size_a) != whole or self._spelt(b, self.flat_b, self.start_b, self.size_b) != whole:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            n_groups, cut_a, cut_b = self._anchors(a, b)
            held, known, get = [], self.windows, self.windows.get
            for i, j, k, m in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b):
                key = packed_a[i:j] + _BETWEEN + packed_b[k:m]
                window = get(key)
                if window is None:
                    window = known[key] = known.before.get(key) or self._align(packed_a[i:j], packed_b[k:m])
                held.append(window)
            pairs, times = np.unique(np.frombuffer(b"".join([x[1] for x in held]), np.int64), return_counts=True)
            yield len(a), len(b), n_groups, int(times.sum()), hashlib.sha256(b";".join([x[0] for x in held])).hexdigest(), pairs, times

    def _anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[int, list[int], list[int]]:
        """How many ends a and b share, and the places in packed a and b of those before tokens that begin with a space."""
        at_a, at_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        place = np.searchsorted(at_b, at_a)
        common = np.flatnonzero(at_b[place] == at_a)
        next_a, next_b = common + 1, place[common] + 1
        keep = np.ones(len(common), bool)  # the end of the text is the last of them
        keep[:-1] = self.space_a[a[next_a[:-1]]] & self.space_b[b[next_b[:-1]]]
        return len(common), (4 * next_a[keep]).tolist(), (4 * next_b[keep]).tolist()


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of each row of docs (doc_id, text).

    pairs: the linked id pairs of the text, A's id * size of B + B's id; times: how often each is linked.
    """
    counts = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        gc.disable()  # what is remembered has no cycles, and would be gone through again and again
        for batch in batches:
            for low, high in slices(batch["text"], 4 << 20):
                part = batch.slice(low, high - low)
                columns = list(zip(*pair.documents(part["text"].to_pylist())))
                arrays = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int32), np.concatenate(c).astype(np.int64)) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays([part["row"], part["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), *arrays], ["row", "doc_id", *counts, "groups_sha256", "pairs", "times"])
        gc.enable()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair, n, best: in how many rows of aligned() a pair is linked, and whether that is the most of its A id."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.floor(F.col("pair") / size_b))
    counts = written(counts)
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return written(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text).

    n_best: links whose pair is the most frequent one of its A id, by documents; count_sum: counts summed over links.
    """
    rows = written(aligned(docs, path_a, path_b))
    counts = pair_counts(rows, len(_pair(path_a, path_b).bytes_b))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    found = links.join(F.broadcast(counts) if counts.count() <= BROADCAST else counts, "pair")
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
