"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and the character n-grams of a text (of code points, over word borders too) hash to
rows of a table of vectors; a document's vector is their mean, and a softmax over two classes reads it. Both are trained
by stochastic gradient descent in numpy, on the driver, from a bounded sample of labelled rows: at most `ROWS_PER_CLASS`
rows of each label, the first by a hash of their id. What comes to the driver of a text is its counts by bucket, at most
`BUCKETS`. Every whole text is then scored in the tasks; as mean and softmax's input are linear, one number for each
bucket is enough.

Results for odd input: a null or blank text has no words and gets the score of the bias alone, or of its white space;
rows without a label, or of an unknown document, train nothing, nor do ids with both labels; of several texts of one id
the one with the least hash trains; with one label or none all scores are 0.5; a null id is held in; ids of any type are
taken, by their text; rows that share an id get one row each; further columns are ignored. Ids, labels, lang and source
are no features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapsync.llm.common import _BYTES, _IN_WORD, Words, mix64, slices

BUCKETS, DIM, NGRAMS, EPOCHS, RATE = 1 << 16, 16, (1, 2, 3), 20, 0.5
ROWS_PER_CLASS = 1500


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word, each two words in a row, and each character n-gram, all white space being one."""
    words = Words(column)
    hashes = words.hashes()
    rows, found = [words.row], [hashes]
    at, pairs = words.windows(hashes, 2)
    rows.append(words.row[at])
    found.append(pairs)
    data = np.where(np.isin(words.bytes, np.frombuffer(b"\t\n\x0b\x0c\r", np.uint8)), np.uint8(32), words.bytes)
    # Code points start at bytes that don't continue one; one place more than there are ends the last.
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    owner = np.searchsorted(words.offsets, places[:-1], side="right") - 1
    values = _BYTES[data]
    sums = _IN_WORD.sums(values)
    for size in NGRAMS:
        at = np.arange(max(0, len(owner) - size + 1))
        at = at[owner[at] == owner[at + size - 1]]
        found.append(mix64(_IN_WORD.between(sums, places[at], places[at + size]) + np.uint64(size * 0x5851F42D4C957F2D & (2**64 - 1))))
        rows.append(owner[at])
    return np.concatenate(rows), (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in slices(batch["text"]):
            part = batch.slice(low, high - low)
            rows, buckets = _features(part["text"])
            keys, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
            bounds = np.searchsorted(keys, np.arange(len(part) + 1) * BUCKETS)
            lists = lambda x: pa.array([x[a:b] for a, b in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], lists((keys % BUCKETS).astype(np.int32)), lists(counts.astype(np.int32))], ["doc_id", "label", "buckets", "counts"])


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, float]:
    """(one number for each bucket, bias): the logit of label 1 is the mean of the numbers plus the bias."""
    known = labels.select(F.col("doc_id").cast("string").alias("label_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    known = known.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    first = [known.where(F.col("label") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(rows_per_class) for k in (0, 1)]
    sample = first[0].unionByName(first[1])
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.mapInArrow(_counted, "doc_id string, label int, buckets array<int>, counts array<int>").toArrow()
    order = np.argsort(found["doc_id"].to_numpy().astype(str), kind="stable")
    y = found["label"].to_numpy()[order]
    if len(np.unique(y)) < 2:
        return np.zeros(BUCKETS), 0.0
    buckets, counts = ([x.values.to_numpy() for x in found[c].take(pa.array(order))] for c in ("buckets", "counts"))
    return fit(buckets, counts, y)


def fit(buckets: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weights, bias = np.zeros((2, DIM)), np.zeros(2)
    shares = [c / max(1, c.sum()) for c in counts]
    balance = len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1 - done / steps)
            done += 1
            mean = shares[i] @ vectors[buckets[i]]
            logits = weights @ mean + bias
            p = np.exp(logits - logits.max())
            wrong = p / p.sum()
            wrong[y[i]] -= 1
            wrong *= balance[y[i]] * rate
            back = wrong @ weights
            weights -= np.outer(wrong, mean)
            bias -= 0.1 * wrong
            # Each feature alone has a small share of the mean; by the root of it, rare ones learn too.
            vectors[buckets[i]] -= (0.2 * np.sqrt(shares[i]))[:, None] * back
    return vectors @ (weights[1] - weights[0]), float(bias[1] - bias[0])


def score_quality(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (columns doc_id, text)."""
    numbers, bias = train(docs.select("doc_id", "text"), labels, rows_per_class)
    numbers = numbers.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                rows, buckets = _features(part["text"])
                total = np.bincount(rows, weights=numbers[buckets], minlength=len(part))
                n = np.bincount(rows, minlength=len(part))
                score = 1 / (1 + np.exp(-np.clip(total / np.maximum(1, n) + bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
