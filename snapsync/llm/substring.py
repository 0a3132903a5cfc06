"""Substring dedup over a de Bruijn graph of word k-mers.

Every run of `span` consecutive words of a document is an edge from the node of its first span-1 words to the node of
its last span-1 words; the two together name all of its words. Edges that rows of two ids hold are repeated. An edge
goes on to the next without a branch if each of its occurrences is followed by that one, and each occurrence of that
one is preceded by it; the ends of texts count as something else. Edges that go on so compact to paths: neighbours in
their source, the row with the least id that has them, become runs, and runs compact by joins that double their reach
(`compact`).

A row that holds the first edge of a path holds all of it, and all edges of a path have one source. So rows are joined
with the first edges of paths only; a path's length says which words it covers in a row, and the SHA-256 of its words
at the source, taken once for a path, must be that of the words in each place of the row where it begins. A document
loses each word that lies under such a place of a path whose source has a smaller id; what isn't the same stays.

Not all edges are shuffled. Each edge has an anchor, the least hash among its k-mers of a third of its length; equal
edges have equal anchors, and neighbouring edges mostly share theirs. Only anchors are counted over the corpus (about
one for 18 words), and only edges whose anchor occurs in two rows become rows. This loses nothing.

Results for odd input: a null or blank text has no words, loses none, and its kept text is the empty string; texts
shorter than `span` lose nothing; rows with a null id lose nothing and remove nothing elsewhere; rows that share an id
are compared with smaller ids only, not with each other; ids of any type that has an order are taken; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapsync.llm.common import Words, mix64, slices, written

_NONE = np.uint64(2**64 - 1)
#: Places of a source that one window of runs takes; a longer source is cut, and its runs meet again as paths.
STRETCH = 1 << 10


def _anchors(words: Words, hashes: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Anchor of each edge (first words at)."""
    k = max(1, span // 3)
    low = np.full(len(hashes), _NONE)
    where, mers = words.windows(hashes, k)
    low[where] = mers
    width, have = span - k + 1, 1
    while have < width:
        step = min(have, width - have)
        low, have = np.minimum(low[: len(low) - step], low[step:]), have + step
    return low[at].view(np.int64) if len(at) else np.zeros(0, np.int64)


def _edges(words: Words, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, tail node, head node and anchor of each edge."""
    hashes = words.hashes()
    where, nodes = words.windows(hashes, span - 1)
    held = np.zeros(len(hashes) + 1, np.uint64)
    held[where] = nodes
    at, _ = words.windows(hashes, span)
    return at, held[at].view(np.int64), held[at + 1].view(np.int64), _anchors(words, hashes, at, span)


def _row_ranges(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for low, high in slices(batch["text"]):
            part = batch.slice(low, high - low)
            yield part, Words(part["text"])


def _summaries(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _parts(batches):
            hashes = words.hashes()
            at, _ = words.windows(hashes, span)
            anchor, bounds = _anchors(words, hashes, at, span), _row_ranges(words.row[at], words.rows)
            texts = part["text"].cast(pa.binary()).to_pylist()
            shas = pa.array([hashlib.sha256(b" ".join((t or b"").split())).digest() for t in texts], pa.binary())
            anchors = pa.array([np.unique(anchor[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(words.counts, pa.int64()), shas, anchors], ["doc_id", "text_key", "n_words", "words_sha", "anchors"])

    return run


def _occurrences(span: int):
    """The edges of a row whose anchors are repeated, each once for what precedes and follows it, at its first place.

    before: the tail of the edge that precedes, after: the head of the one that follows; null where the text ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _parts(batches):
            at, tail, head, anchor = _edges(words, span)
            bounds, anchors = _row_ranges(words.row[at], words.rows), part["anchors"]
            before, after = np.roll(tail, 1), np.roll(head, -1)
            first, last = np.zeros(len(at), bool), np.zeros(len(at), bool)
            first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
            last[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = True
            around = _name(_name(tail, head).view(np.int64), _name(np.where(first, 0, before), np.where(last, 0, after)).view(np.int64)) + first + 2 * last
            found = [np.zeros(0, np.int64)]
            for i in range(words.rows):
                a, b = bounds[i], bounds[i + 1]
                hit = np.flatnonzero(np.isin(anchor[a:b], anchors[i].values.to_numpy())) + a
                found.append(hit[np.sort(np.unique(around[hit], return_index=True)[1])])
            hit = np.concatenate(found)
            row = words.row[at[hit]]
            take = pa.array(row)
            columns = [part["row"].take(take), part["doc_id"].take(take), pa.array((at[hit] - words.first_word[row]).astype(np.int32)), pa.array(tail[hit]), pa.array(head[hit]), pa.array(before[hit], mask=first[hit]), pa.array(after[hit], mask=last[hit])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "place", "tail", "head", "before", "after"])

    return run


def _name(tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """One number for an edge, good enough within a text."""
    return mix64(tail.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) ^ head.view(np.uint64)


def repeated_edges(occurrences: DataFrame) -> DataFrame:
    """tail, head, doc_id, row, place, before, after of each edge that rows of two ids hold, in the row with the least.

    before, after: those of all its occurrences; null if they differ or a text ends there.
    """
    only = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    edges = occurrences.groupBy("tail", "head").agg(F.min(F.struct("doc_id", "row", "place")).alias("source"), F.max("doc_id").alias("last_doc"), only("before"), only("after"))
    return edges.where("source.doc_id < last_doc").select("tail", "head", "source.*", "before", "after")


def _around(*nodes) -> Column:
    """Three nodes, or null if one of them is."""
    known = [F.col(n) if isinstance(n, str) else n for n in nodes]
    there = known[0].isNotNull() & known[1].isNotNull() & known[2].isNotNull()
    return F.when(there, F.struct(*(n.alias(x) for n, x in zip(known, "abc"))))


def source_runs(edges: DataFrame) -> DataFrame:
    """run, n, doc_id, row, place, tail, head, enters, leaves: edges that go on without a branch in a piece of a source.

    place, tail, head: of its first edge. enters: the nodes before, at and after its beginning, leaves: those at its end;
    null where it branches. The run that it goes on to enters as it leaves.
    """
    rows = edges.withColumn("enters", _around("before", "tail", "head")).withColumn("leaves", _around("tail", "head", "after"))
    order = Window.partitionBy("row", F.floor(F.col("place") / STRETCH)).orderBy("place")
    goes_on = (F.lag("place").over(order) == F.col("place") - 1) & (F.lag("leaves").over(order) == F.col("enters"))
    starts = F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("place"))
    rows = rows.withColumn("first", F.max(starts).over(order))
    at = lambda c, end: end(c, "place").alias(c)
    runs = rows.groupBy("doc_id", "row", F.col("first").alias("at")).agg(F.count(F.lit(1)).alias("n"), at("tail", F.min_by), at("head", F.min_by), at("enters", F.min_by), at("leaves", F.max_by))
    return runs.withColumnRenamed("at", "place").withColumn("run", F.monotonically_increasing_id())


def compact(runs: DataFrame, branching: DataFrame | None = None) -> DataFrame:
    """run, path, offset of each row of runs (run, n, tail, head): the path's first run, and the edges before this one.

    A run's predecessor ends in what it begins with (null: nothing), if that isn't branching (node). In each round a run
    asks the one that it points to where that points, so reach doubles. Runs in a ring never get to an end; each is its
    own path.
    """
    ends = runs.select(F.col("run").alias("before"), F.col("n").alias("offset"), F.col("head").alias("tail"))
    links = runs.select("run", "tail").join(ends, "tail")
    if branching is not None:
        links = links.join(branching.select(F.col("node").alias("tail")), "tail", "left_anti")
    state = written(runs.select("run").join(links.select("run", "before", "offset"), "run", "left").select("run", F.coalesce("before", "run").alias("path"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset")))
    total, reach = state.count(), 1
    while True:
        ends_at = state.select(F.col("run").alias("path"), F.col("path").alias("further"), F.col("offset").alias("more"))
        moved = written(state.join(ends_at, "path").select("run", "path", F.col("further").alias("next"), F.col("offset").alias("was"), (F.col("offset") + F.col("more")).alias("offset")))
        state, reach = moved.select("run", F.col("next").alias("path"), "offset"), 2 * reach
        open_ = moved.where("path <> next")
        if open_.isEmpty():
            return state
        if reach > 2 * total:  # as far as any chain can go: what is still open goes round
            ring = moved["path"] != moved["next"]
            return moved.select("run", F.when(ring, F.col("run")).otherwise(F.col("next")).alias("path"), F.when(ring, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"))


def whole_paths(runs: DataFrame, reach: DataFrame) -> DataFrame:
    """path, doc_id, row, place, tail, head, edges: where each path begins in its source, its first edge and length."""
    begins = lambda c: F.min_by(c, "offset").alias(c)
    return runs.join(reach, "run").groupBy("path").agg(*(begins(c) for c in ("doc_id", "row", "place", "tail", "head")), F.sum("n").cast("int").alias("edges"))


def met_paths(occurrences: DataFrame, paths: DataFrame) -> DataFrame:
    """row, path of each path of a smaller document that a row holds."""
    first = paths.select("tail", "head", "path", F.col("doc_id").alias("source_doc"))
    # Both sides are dealt out anew for this join, so Spark can split hot edges.
    return occurrences.join(first, ["tail", "head"]).where("doc_id > source_doc").select("row", "path").distinct()


def _words_digest(words: list[bytes], first: int, edges: int, span: int) -> bytes:
    return hashlib.sha256(b" ".join(words[first : first + edges + span - 1])).digest()


def _source_digests(span: int):
    """The digest of the words of each path at its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, paths in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["paths"].to_pylist()):
                words = text.split()
                yield pa.RecordBatch.from_pylist([{"path": x["path"], "sha": _words_digest(words, x["place"], x["edges"], span)} for x in paths], schema=_DIGESTS)

    return run


_DIGESTS = pa.schema([("path", pa.int64()), ("sha", pa.binary())])


def _removals(span: int):
    """Words under the paths of smaller documents go, wherever such a path begins and its words are the source's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _parts(batches):
            at, tail, head, _ = _edges(words, span)
            bounds = _row_ranges(words.row[at], words.rows)
            removed, spans, kept = [], [], []
            for i, (text, paths) in enumerate(zip(part["text"].cast(pa.binary()).to_pylist(), part["paths"].to_pylist())):
                tails, heads, tokens = tail[bounds[i] : bounds[i + 1]], head[bounds[i] : bounds[i + 1]], text.split()
                order = np.argsort(tails, kind="stable")
                asked = np.array([x["tail"] for x in paths], np.int64)
                low, high = (np.searchsorted(tails[order], asked, side) for side in ("left", "right"))
                cover = np.zeros(len(tokens) + 1, np.int64)
                for x, a, b in zip(paths, low.tolist(), high.tolist()):
                    for place in order[a:b].tolist():
                        if heads[place] == x["head"] and _words_digest(tokens, place, x["edges"], span) == x["sha"]:
                            cover[place] += 1
                            cover[place + x["edges"] + span - 1] -= 1
                keep = np.cumsum(cover)[:-1] == 0
                removed.append(int(len(keep) - keep.sum()))
                spans.append(int((~keep & np.concatenate([[True], keep[:-1]])).sum()))
                kept.append(hashlib.sha256(b" ".join([w for w, k in zip(tokens, keep.tolist()) if k])).digest())
            yield pa.RecordBatch.from_arrays([part["row"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_removed", "n_stretches", "kept_sha"])

    return run


def dedup_substrings(docs: DataFrame, span: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_stretches of each row of docs (columns doc_id, text); span: 2 or more.

    n_stretches: stretches of words that the row lost; a whole copy of an earlier document is one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    summary = written(docs.mapInArrow(_summaries(span), f"doc_id {kind}, text_key long, n_words long, words_sha binary, anchors array<long>").withColumn("row", F.monotonically_increasing_id()))
    # Whole copies of an earlier document go entirely; they need no look at their edges.
    # Written, so that both sides of the join are dealt out anew and Spark can split a text that very many rows hold.
    copied = written(summary.where((F.col("n_words") >= span) & F.col("doc_id").isNotNull()).groupBy("words_sha").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc"))
    marked = written(summary.join(copied, "words_sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False))).drop("first_doc"))
    anchors = marked.where(~F.col("copy") & F.col("doc_id").isNotNull()).select("row", F.explode("anchors").alias("anchor"))
    repeated = written(anchors.groupBy("anchor").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("anchor"))
    wanted = anchors.join(repeated, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    wanted = written(wanted.join(marked.select("row", "doc_id", "text_key"), "row"))
    # The same text under the same id is looked at once.
    texts = docs.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("row", "doc_id", "text_key", "text", "anchors")
    texts = written(texts)
    occurrences = written(texts.select("row", "doc_id", "text", "anchors").mapInArrow(_occurrences(span), f"row long, doc_id {kind}, place int, tail long, head long, before long, after long"))
    runs = written(source_runs(written(repeated_edges(occurrences))))
    paths = written(whole_paths(runs, compact(runs.select("run", "n", F.col("enters").alias("tail"), F.col("leaves").alias("head")))))
    asked = paths.groupBy("row").agg(F.collect_list(F.struct("path", "place", "edges")).alias("paths"))
    digests = texts.select("row", "text").join(asked, "row").select("text", "paths").mapInArrow(_source_digests(span), "path long, sha binary")
    known = paths.select("path", "tail", "head", "edges").join(digests, "path")
    met = met_paths(occurrences, paths).join(known, "path").groupBy("row").agg(F.collect_list(F.struct("tail", "head", "edges", "sha")).alias("paths"))
    # Both joins with texts deal out the same columns by the same key, so Spark shuffles the texts once.
    changed = texts.select("row", "text").join(met, "row").mapInArrow(_removals(span), "row long, n_removed long, n_stretches long, kept_sha binary")
    changed = changed.join(texts.select("row", "doc_id", "text_key"), "row").drop("row")
    nothing = F.lit(hashlib.sha256(b"").digest())
    whole = lambda c: F.when(F.col("copy"), c)
    return marked.drop("anchors", "row").join(changed, ["doc_id", "text_key"], "left").select(
        "doc_id",
        "n_words",
        whole(F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(whole(nothing).otherwise(F.coalesce("kept_sha", "words_sha")))).alias("kept_sha256"),
        whole(F.lit(1)).otherwise(F.coalesce("n_stretches", F.lit(0))).cast("long").alias("n_stretches"),
    )


#: The rows of dedup_substrings(documents) without n_stretches, by all windows.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) u(i) WHERE len(w) >= 50 AND doc_id IS NOT NULL),
least AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, i + j AS k FROM win JOIN least USING (h), range(0, 50) s(j) WHERE low < doc_id),
words AS (SELECT r, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) u(i)),
kept AS (SELECT words.r, string_agg(x, ' ' ORDER BY i) AS t FROM words LEFT JOIN gone ON words.r = gone.r AND words.i = gone.k WHERE gone.k IS NULL GROUP BY words.r),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(counts.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""
