"""SentencePiece encoding and decoding by streaming Viterbi over a vocabulary's scores.

The best segmentation of a text is the path of pieces with the largest sum of scores. A stream keeps the scores of as
many boundaries as the longest piece has characters, and backpointers from the last committed boundary on. A boundary
survives while the characters after it begin some piece; when the backpointer paths of all that survive run through one
boundary, what lies before it can't change any more: its ids are committed and its backpointers given up.

Where no piece of the vocabulary holds a word mark after other characters, every path runs through the boundary before
a word mark, whatever follows. Texts are cut there; each distinct stretch is a stream, and those met before are looked
up. Many streams go forward in step, one boundary at a time, as rows of numpy arrays (`encode_batch`); long ones, whose
steps would serve few rows, go one by one (`encode_stream`): the same window, the same commits.

The vocabulary file is read as it is; its scores are taken as those of a unigram model whatever the type that it was
trained as. Characters that no piece covers cost ten less than the worst piece and become byte pieces.

Results for odd input: null and empty texts have no ids and decode to the empty text; rows that share an id get one
row each; the id column keeps its type, further columns are ignored; a word mark (U+2581) in a text is taken as a
space, as the library does, so such a text decodes with spaces there and its round_trip is false.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapsync.llm.common import KeyTable, Rolling, mix64, slices

MARK = "▁"
#: Distinct stretches that a worker keeps with their ids before it starts afresh.
KEPT = 1_000_000
#: Streams that go forward together, and the length from which a stream goes alone.
TOGETHER, ALONE = 20_000, 512
#: Code points of a part of a long text.
PART = 1 << 20


_IN_TEXT = Rolling(0xA24BAED4963EE407)


def _code_points(text: str) -> np.ndarray:
    return mix64(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))


def _range_keys(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64(_IN_TEXT.between(sums, starts, ends) ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.pieces[piece] = (model.get_score(i), i)
                self.text.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min((s for s, _ in self.pieces.values()), default=0.0) - 10.0
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.prefixes = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        names = sorted(self.prefixes)
        lengths = np.array([len(p) for p in names], np.int64)
        ends = np.cumsum(lengths)
        self._table = KeyTable(_range_keys(_IN_TEXT.sums(_code_points("".join(names))), ends - lengths, ends))
        held = [self.pieces.get(p, (-np.inf, -1)) for p in names] + [(-np.inf, -1)]
        self._scores, self._ids = np.array([score for score, _ in held]), np.array([i for _, i in held], np.int32)
        self.text_bytes, self.text_sizes = np.frombuffer(b"".join(self.text), np.uint8), np.array([len(t) for t in self.text], np.int64)
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.commits = 0  # made before a stream's end, by encode_batch and encode_stream

    def encode_stream(self, text: str) -> list[int]:
        """Ids of the best path; state is bounded by the longest piece, however long the text."""
        pieces, prefixes, longest, unknown = self.pieces, self.prefixes, self.longest, self.unknown
        n, ids, base = len(text), [], 0  # base: the committed boundary
        best, back = [0.0], [(0, -1)]  # of boundary base + i: score, (start, id)
        ahead: list[float] = [-np.inf] * (longest + 1)
        ahead_back: list[tuple[int, int]] = [(0, -1)] * (longest + 1)
        for at in range(n):
            here = best[at - base]
            end, covered = at + 1, False
            limit = min(n, at + longest)
            while end <= limit:
                part = text[at:end]
                if part not in prefixes:
                    break
                found = pieces.get(part)
                if found is not None:
                    covered |= end == at + 1
                    score = here + found[0]
                    if score > ahead[end - at]:
                        ahead[end - at], ahead_back[end - at] = score, (at, found[1])
                end += 1
            if not covered and here + unknown > ahead[1]:
                ahead[1], ahead_back[1] = here + unknown, (at, -1)
            best.append(ahead[1])
            back.append(ahead_back[1])
            ahead = [-np.inf, *ahead[2:], -np.inf]
            ahead_back = [(0, -1), *ahead_back[2:], (0, -1)]
            if len(best) > 4 * longest and at + 1 < n:
                base = self._commit(text, ids, best, back, ahead_back, ahead, at + 1, base)
        self._path(text, ids, back, base, n)
        return ids

    def encode_batch(self, codes: np.ndarray, sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all streams in a row, number of ids of each); stream i is codes[starts[i] : starts[i] + sizes[i]], sums are those of all code points."""
        order = np.argsort(-sizes, kind="stable")
        parts = [self._together(sums, starts[rows], sizes[rows], rows) for rows in (order[i : i + TOGETHER] for i in range(0, len(order), TOGETHER))]
        row, end, begin, piece = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        by_place = np.lexsort((end, row))
        row, begin, piece = row[by_place], begin[by_place], piece[by_place]
        bare = np.flatnonzero(piece == -1)
        each = np.ones(len(row), np.int64)
        as_bytes = [chr(c).encode("utf-8", "surrogatepass") for c in codes[starts[row[bare]] + begin[bare]].tolist()]
        each[bare] = [len(b) for b in as_bytes]
        ids = np.repeat(piece, each).astype(np.int32)
        ids[ids == -1] = [self.bytes[b] for b in b"".join(as_bytes)]
        return ids, np.bincount(row, weights=each, minlength=len(sizes)).astype(np.int64)

    def _together(self, sums: np.ndarray, first: np.ndarray, size: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, ...]:
        """(stream, end, start, id) of each piece on the best paths; streams come longest first, id is -1 for bytes."""
        n, longest = len(size), self.longest
        ring, hold, every = longest + 1, 4 * longest, max(1, longest // 2)
        score = np.full((n, ring), -np.inf)  # of boundary b: column b % ring
        score[:, 0] = 0.0
        back, piece = np.zeros((n, hold), np.int64), np.full((n, hold), -1, np.int32)  # of boundary b: column b % hold
        base = np.zeros(n, np.int64)
        out: list[tuple[np.ndarray, ...]] = []

        def commit(rows: np.ndarray, to: np.ndarray) -> None:
            at, base_of = to.copy(), base[rows]
            live = np.flatnonzero(at > base_of)
            while len(live):
                r, column = rows[live], at[live] % hold
                out.append((names[r], at[live], back[r, column], piece[r, column]))
                at[live] = back[r, column]
                live = live[at[live] > base_of[live]]
            base[rows] = to

        for end in range(1, int(size[0]) + 1 if n else 0):
            m = int(np.searchsorted(-size, -end, side="right"))
            starts = np.arange(max(0, end - longest), end)
            keys = _range_keys(sums, (first[:m, None] + starts).ravel(), np.repeat(first[:m] + end, len(starts)))
            found = self._table.find(keys).reshape(m, len(starts))
            if end % every == 0 and end > every:
                # Boundaries that survive: their characters up to here begin a piece; the last one always does.
                ways = np.where(found >= 0, starts, end - 1)
                rows = np.flatnonzero(ways.min(axis=1) > base[:m])
                while len(rows):
                    top = ways[rows].max(axis=1)
                    apart = ways[rows].min(axis=1) < top
                    rows, top = rows[apart], top[apart]
                    ways[rows] = np.where(ways[rows] == top[:, None], back[rows, top % hold][:, None], ways[rows])
                rows = np.flatnonzero((ways.min(axis=1) == ways.max(axis=1)) & (ways[:, 0] > base[:m]))
                self.commits += len(rows)
                commit(rows, ways[rows, 0])
                if end + every - int(base[:m].min()) >= hold:  # some paths still differ: more room for backpointers
                    wide, kept = 2 * hold, np.arange(max(0, end - hold + 1), end)
                    (old_back, old_piece), (back, piece) = (back, piece), (np.zeros((n, wide), np.int64), np.full((n, wide), -1, np.int32))
                    back[:, kept % wide], piece[:, kept % wide] = old_back[:, kept % hold], old_piece[:, kept % hold]
                    hold = wide
            scores = score[:m, starts % ring] + self._scores[found]
            bare = self._ids[found[:, -1]] == -1
            scores[bare, -1] = score[:m][bare, (end - 1) % ring] + self.unknown
            pick, at = np.argmax(scores, axis=1), np.arange(m)
            score[:m, end % ring], back[:m, end % hold], piece[:m, end % hold] = scores[at, pick], starts[pick], self._ids[found[at, pick]]
            done = np.arange(int(np.searchsorted(-size, -end - 1, side="right")), m)
            commit(done, np.full(len(done), end))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4

    def _commit(self, text: str, ids: list[int], best: list[float], back: list, ahead_back: list, ahead: list[float], at: int, base: int) -> int:
        """Commit up to the last boundary that the paths of this and of all open ends share."""
        ends = {at, *(start for score, (start, _) in zip(ahead[1:], ahead_back[1:]) if score > -np.inf)}
        while len(ends) > 1:
            last = max(ends)
            ends.discard(last)
            ends.add(back[last - base][0])
        (shared,) = ends
        if shared > base:
            self.commits += 1
            self._path(text, ids, back, base, shared)
            del best[: shared - base], back[: shared - base]
        return shared

    def _path(self, text: str, ids: list[int], back: list, base: int, end: int) -> None:
        out: list[int] = []
        while end > base:
            start, piece = back[end - base]
            out.extend([piece] if piece >= 0 else [self.bytes[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass"))])
            end = start
        ids.extend(reversed(out))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of ranges of the given starts and sizes, one range after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Codec:
    """Encoder and decoder with a memory of stretches met before: sorted keys, places and ids, all in arrays."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self._keys, self._starts, self._sizes, self._ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, codes: np.ndarray, sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        alone = np.flatnonzero(sizes > ALONE)
        rest = np.flatnonzero(sizes <= ALONE)
        ids, counts = self.vocabulary.encode_batch(codes, sums, starts[rest], sizes[rest])
        one_by_one = [np.array(self.vocabulary.encode_stream(codes[starts[i] : starts[i] + sizes[i]].tobytes().decode("utf-32-le", "surrogatepass")), np.int32) for i in alone]
        ids = np.concatenate([ids, *one_by_one])
        counts = np.concatenate([counts, np.array([len(x) for x in one_by_one], np.int64)])
        order = np.argsort(np.concatenate([rest, alone]))  # back in the order of the keys
        at = np.searchsorted(self._keys, keys)
        self._starts = np.insert(self._starts, at, (len(self._ids) + np.cumsum(counts) - counts)[order])
        self._sizes = np.insert(self._sizes, at, counts[order])
        self._keys = np.insert(self._keys, at, keys)
        self._ids = np.concatenate([self._ids, ids])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text) of an Arrow column without nulls."""
        codes = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.asarray(pa.compute.utf8_length(column).to_numpy(zero_copy_only=False), np.int64)
        used = np.flatnonzero(lengths)
        row_starts = np.cumsum(lengths[used] + 1) - lengths[used] - 1
        text = np.full(len(codes) + len(used), ord(MARK), np.uint32)  # a mark before each text
        inner = np.ones(len(text), bool)
        inner[row_starts] = False
        text[inner] = np.where(codes == 32, ord(MARK), codes)
        mark = text == ord(MARK)
        cut = np.zeros(len(text), bool) if self.vocabulary.whole else mark & ~np.concatenate([np.zeros(1, bool), mark[:-1]])
        cut[row_starts] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(text))
        sums = _IN_TEXT.sums(mix64(text.astype(np.uint64) + np.uint64(1)))
        keys, first, inverse = np.unique(_range_keys(sums, starts, ends), return_index=True, return_inverse=True)
        if len(self._keys) + len(keys) > KEPT:
            self._forget()
        at = np.searchsorted(self._keys, keys)
        new = np.flatnonzero(self._keys[np.minimum(at, len(self._keys) - 1)] != keys) if len(self._keys) else np.arange(len(keys))
        if len(new):
            self._learn(keys[new], text, sums, starts[first[new]], (ends - starts)[first[new]])
            at = np.searchsorted(self._keys, keys)
        place = at[inverse]
        sizes = self._sizes[place]
        ids = self._ids[_ragged(self._starts[place], sizes)]
        counts = np.zeros(len(column), np.int64)
        counts[used] = np.bincount(np.searchsorted(row_starts, starts, side="right") - 1, weights=sizes, minlength=len(used))
        return ids, counts

    def encode(self, text: str, part: int = PART) -> np.ndarray:
        """Ids of one text; a long one goes in parts, cut before word marks."""
        ids, at = [], 0
        while not self.vocabulary.whole and len(text) - at > 2 * part:
            cut = at + part
            while 0 < (cut := text.find(" ", cut)) < len(text) - 1 and text[cut - 1] == " ":
                cut += 1
            if not 0 < cut < len(text) - 1:
                break
            ids.append(self.encode_column(pa.array([text[at:cut]], pa.string()))[0])
            at = cut + 1  # the mark before each part stands for this space
        return np.concatenate([*ids, self.encode_column(pa.array([text[at:]], pa.string()))[0]])

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        own = self.vocabulary
        return own.text_bytes[_ragged(own.text_starts[ids], own.text_sizes[ids])]

    def decode(self, ids: np.ndarray) -> str:
        text = self.decode_bytes(ids).tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def round_trips(self, column: pa.Array, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each text of a column, whether its ids decode to it."""
        decoded, ends = self.decode_bytes(ids), np.cumsum(counts)
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.vocabulary.text_sizes[ids])])
        low, high = at[ends - counts], at[ends]
        texts = column.cast(pa.large_binary()).to_pylist()
        whole = decoded.tobytes()
        return np.array([whole[a:b] == (b" " + t if t else b"") for a, b, t in zip(low.tolist(), high.tolist(), texts)], bool)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, n_ids, round_trip (the ids decode to the text) of each row of docs (columns doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                if high - low == 1:
                    ids = own.encode(part["text"][0].as_py())
                    counts = np.array([len(ids)], np.int64)
                else:
                    ids, counts = own.encode_column(part["text"])
                offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(counts)]).astype(np.int32)
                right = own.round_trips(part["text"], ids, counts)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(counts), pa.array(right)], ["doc_id", "ids", "n_ids", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids long, round_trip boolean")


def decode_ids(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of each row of rows (columns doc_id, ids); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([own.decode(np.array(i or [], np.int32)) for i in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
