"""Similarity self-join of documents by the Jaccard coefficient of their sets of word n-grams: chosen-path join.

Documents with the same set are one class; a class's set is sketched by its least hashes under `TOKENS` functions, so
that each class has as many tokens (function, value), and two classes share a token with the probability of their
coefficient. A run sends a class down the paths of those of its tokens that a hash of path and token selects, about
1 / (threshold * TOKENS) of them: similar classes meet in a bucket, and go on meeting as the path grows. Buckets of
two to `SMALL` classes are leaves; larger ones are split again, up to `DEPTH` tokens deep.

Pairs are compared in the leaves and nowhere else. A pair that meets in several leaves counts in the least of them, as
each class brings the list of its leaves along. In a leaf the lists and sketches tell first which classes have a partner
to count there; only those bring their whole sets to it, and the sets decide. Leaves that are large to the end hold
groups of near copies, nearly the same ones over and over: those that share classes are one cluster, whose pairs are
compared once, in blocks of at most `BLOCK` sets. Tasks give, for each class, its number of links in a leaf or block and
one link to the first class that it reaches there, never the pairs.

The number of runs follows from the recall that is asked for. It is then measured: pairs met in even runs and in odd
runs are two catches of the same links, and what they have in common tells the share that both missed. While the
measured recall is too low, the search is repeated with twice the runs.

Results for odd input: null or blank texts, and rows with a null id, link with nothing and are kept; a text shorter
than n words has one n-gram, all its words; rows that share id and text are one class; ids of any type that has an
order are taken; further columns are ignored, and keep_first() keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapsync.llm.common import _IN_WINDOW, Words, by_group, free_names, mix64, slices, written
from snapsync.llm.components import components

TOKENS, SMALL, DEPTH = 64, 128, 4
#: Sets and n-grams of a block of a cluster.
BLOCK, BLOCK_GRAMS = 1024, 1 << 21
#: Share of equal tokens from which whole sets are compared: the threshold less four standard errors.
SLACK = 4.0
#: Bits of a bucket's number below the number of its run, and the runs that there is room for.
RUN_BITS, MOST_RUNS = 48, 1 << 14
_MULTIPLIERS = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix64(np.arange(1001, TOKENS + 1001, dtype=np.uint64))


def runs_for(recall: float, threshold: float) -> int:
    """Runs until two classes at the threshold share a bucket, DEPTH tokens deep, with this probability."""
    runs = 1
    while loss(runs, threshold) > 1 - recall:
        runs += 1
    return runs


def loss(runs: int, threshold: float) -> float:
    """The probability that they share none. All runs see one sketch: the tokens shared there spread binomially."""
    chosen, total = 1 / (threshold * TOKENS), 0.0
    for shared in range(TOKENS + 1):
        lost = 0.0
        for _ in range(DEPTH):
            lost = (1 - chosen * (1 - lost)) ** shared
        total += math.comb(TOKENS, shared) * threshold**shared * (1 - threshold) ** (TOKENS - shared) * lost**runs
    return total


def _shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each row, sorted by both."""
    hashes = words.hashes()
    at, grams = words.windows(hashes, n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    whole = mix64(_IN_WINDOW.ranges(hashes, words.first_word[short], words.first_word[short + 1]) + np.uint64(n))
    rows, grams = np.concatenate([words.row[at], short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new]


def _sketches(n: int, kind: str):
    """Every row with two digests of its set (null for none), the set's size and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                rows, grams = _shingles(Words(part["text"]), n)
                with_grams, starts = np.unique(rows, return_index=True)
                sketch, sizes = np.empty((len(with_grams), TOKENS), np.uint32), np.diff(np.append(starts, len(rows)))
                digests = np.zeros((2, len(with_grams)), np.int64)
                if len(rows):
                    for j in range(TOKENS):
                        sketch[:, j] = np.minimum.reduceat(((grams * _MULTIPLIERS[j] + _OFFSETS[j]) >> np.uint64(32)).astype(np.uint32), starts)
                    for j, salt in enumerate((0x6A09E667F3BCC909, 0xBB67AE8584CAA73B)):
                        digests[j] = mix64(np.add.reduceat(mix64(grams ^ np.uint64(salt)), starts) + sizes.astype(np.uint64)).view(np.int64)
                place = np.full(len(part), -1)
                place[with_grams] = np.arange(len(with_grams))
                take = pa.array(place, mask=place < 0)
                held = [*(pa.array(d) for d in digests), pa.array(sizes.astype(np.int64)), pa.array([s.tobytes() for s in sketch], pa.binary())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], *(h.take(take) for h in held)], ["doc_id", "text_key", "low", "high", "n_grams", "sketch"])

    return run, f"doc_id {kind}, text_key long, low long, high long, n_grams long, sketch binary"


def _paths(first: int, runs: int, threshold: float):
    """Buckets one token further: of the roots of runs from first on (bucket null), or of the bucket given."""
    limit = np.uint64(int(2**64 / (threshold * TOKENS)))
    roots = mix64(np.arange(7001 + first, 7001 + first + runs, dtype=np.uint64))
    numbers = np.arange(first, first + runs, dtype=np.int64) << RUN_BITS
    salts = mix64(np.arange(9001, 9001 + TOKENS, dtype=np.uint64))
    low_bits = np.uint64((1 << RUN_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                tokens = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint32).reshape(-1, TOKENS).astype(np.uint64)
                tokens = mix64(tokens ^ salts)
                reps = batch["rep"].to_numpy()
                given = None if batch["bucket"].null_count else batch["bucket"].to_numpy()
                for i, root in enumerate(roots) if given is None else [(0, None)]:
                    chosen = mix64(tokens + (root if given is None else given.view(np.uint64)[:, None]))
                    row, column = np.nonzero(chosen < limit)
                    bucket = (mix64(chosen[row, column] ^ np.uint64(0x3C6EF372FE94F82B)) & low_bits).view(np.int64)
                    bucket |= numbers[i] if given is None else given[row] & ~np.int64(low_bits)
                    yield pa.RecordBatch.from_arrays([pa.array(reps[row]), pa.array(bucket)], ["rep", "bucket"])

    return run


def leaves(sketches: DataFrame, first: int, runs: int, threshold: float) -> DataFrame:
    """rep, bucket, large of the leaves of some runs that hold two classes or more; sketches: rep (unique), sketch."""
    found = []
    level = sketches.withColumn("bucket", F.lit(None).cast("long"))
    for depth in range(1, DEPTH + 1):
        rows = written(level.select("rep", "bucket", "sketch").mapInArrow(_paths(first, runs, threshold), "rep long, bucket long"))
        sizes = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        met = rows.join(sizes, "bucket")
        split = F.col("n") > SMALL
        if depth == DEPTH:
            found.append(met.select("rep", "bucket", split.alias("large")))
            break
        found.append(met.where(~split).select("rep", "bucket", F.lit(False).alias("large")))
        if sizes.where(split).isEmpty():
            break
        level = met.where(split).join(sketches, "rep")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _shared(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n rows have in common; (row, value) are distinct."""
    common = np.zeros((n, n), np.float32)
    _, column = np.unique(values, return_inverse=True)
    held = np.bincount(column)
    places = np.cumsum(held > 1) - 1
    row, column = rows[held[column] > 1], places[column[held[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column, step = row[order], column[order], 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        dense = np.zeros((n, min(step, int(column[-1]) + 1 - low)), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        common += dense @ dense.T
    return common


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists of whole numbers."""
    whole = column.combine_chunks()
    return np.repeat(np.arange(len(whole)), np.diff(whole.offsets.to_numpy())), whole.flatten().to_numpy()


def _elsewhere(group: pa.Table, bucket: int) -> np.ndarray:
    """Which pairs of a leaf's classes meet in a small leaf of a lesser number too, or are of one cluster."""
    row, leaf = _lists(group["leaves"])
    cluster = group["cluster"].to_numpy()
    return (_shared(row[leaf < bucket], leaf[leaf < bucket], len(group)) > 0) | (cluster[:, None] == cluster[None, :])


def _with_partner(threshold: float):
    """The classes of small leaves that have a partner there, by their sketches."""
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), group in by_group(batches, ["bucket"]):
            tokens = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint32).reshape(len(group), TOKENS)
            near = (tokens[:, None, :] == tokens[None, :, :]).mean(axis=2) >= least
            reps = group["rep"].to_numpy()
            near &= reps[:, None] != reps[None, :]
            if near.any():
                near &= ~_elsewhere(group, bucket)
                some = near.any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(np.full(int(some.sum()), bucket, np.int64))], ["rep", "bucket"])

    return run


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows (rep, bucket, blocks, ...) once for each block of their bucket, with own block and pair of blocks (one, two)."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return rows.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).drop("blocks", "other")


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each node of a small symmetric matrix of links, the first node that it reaches."""
    n = len(linked)
    root = np.arange(n)
    while True:
        best = np.where(linked, root[None, :], n).min(axis=1)
        new = np.minimum(root, best)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            return root
        root = new


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                rows, grams = _shingles(Words(part["text"]), n)
                bounds = np.searchsorted(rows, np.arange(len(part) + 1))
                packed = pa.array([grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part["rep"], part["copies"], packed], ["rep", "copies", "grams"])

    return run


def _compare(parts: int, whole: int):
    """Links at a coefficient of at least parts / whole in one leaf, or in one block of a cluster or between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, _, _), group in by_group(batches, ["bucket", "one", "two"]):
            sets = [np.frombuffer(g, np.uint64) for g in group["grams"].to_pylist()]
            reps, copies, side = (group[c].to_numpy() for c in ("rep", "copies", "own"))
            sizes, n = np.fromiter(map(len, sets), np.int64, len(sets)), len(sets)
            common = _shared(np.repeat(np.arange(n), sizes), np.concatenate(sets), n).astype(np.float64)
            # c / (m + n - c) >= parts / whole, in whole numbers
            linked = (whole + parts) * common >= parts * (sizes[:, None] + sizes[None, :]) - 1e-6
            linked &= reps[:, None] != reps[None, :]
            if (side != side[0]).any():
                linked &= side[:, None] != side[None, :]
            if not linked.any():
                continue
            catches = np.zeros((3, n), np.int64)
            if bucket >= 0:
                linked &= ~_elsewhere(group, bucket)
                row, leaf = _lists(group["leaves"])
                odd = (leaf >> RUN_BITS) % 2 == 1
                one, two = (linked & (_shared(row[of], leaf[of], n) > 0) for of in (~odd, odd))
                catches = np.stack([x.sum(axis=1) for x in (one, two, one & two)])
            some = linked.any(axis=1)
            rank = np.argsort(reps, kind="stable")
            root = np.empty(n, np.int64)
            root[rank] = rank[local_roots(linked[np.ix_(rank, rank)])]
            columns = [reps[some], reps[root[some]], (linked @ copies)[some].astype(np.int64), *catches[:, some]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["a", "b", "links", "even", "odd", "both"])

    return run


def clusters(met: DataFrame) -> DataFrame:
    """rep, cluster of the classes in large leaves: leaves that share a class are of one cluster."""
    first = F.min("bucket").over(Window.partitionBy("rep"))
    large = written(met.where("large").select("rep", "bucket", first.alias("home")))
    roots = components(large.select(F.col("bucket").alias("a"), F.col("home").alias("b")))
    return large.select("rep", "home").distinct().join(roots, F.col("home") == F.col("node"), "left").select("rep", F.coalesce("root", "home").alias("cluster"))


def _links(classes: DataFrame, docs: DataFrame, met: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """a, b, links, even, odd, both: verified links of the leaves met (rep, bucket, large)."""
    parts, whole = threshold
    clustered = written(clusters(met))
    lists = met.where(~F.col("large")).groupBy("rep").agg(F.collect_list("bucket").alias("leaves")).join(clustered, "rep", "full")
    none = F.array().cast("array<bigint>")
    lists = written(lists.select("rep", F.coalesce("leaves", none).alias("leaves"), F.coalesce("cluster", -1 - F.col("rep")).alias("cluster")))
    small = met.where(~F.col("large")).select("rep", "bucket").join(classes.select("rep", "sketch"), "rep").join(lists, "rep")
    some = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_with_partner(parts / whole), "rep long, bucket long")
    # Clusters go by negative numbers.
    need = written(some.unionByName(clustered.select("rep", (-1 - F.col("cluster")).alias("bucket"))))
    wanted = need.select("rep").distinct().join(classes.drop("sketch"), "rep")
    blocks = F.when(F.col("bucket") >= 0, 1).otherwise(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_grams") / BLOCK_GRAMS))).cast("int")
    sizes = written(need.join(classes.select("rep", "n_grams"), "rep").groupBy("bucket").agg(blocks.alias("blocks")))
    texts = docs.withColumnsRenamed({"doc_id": "class_id", "text_key": "class_key"})
    sets = written(texts.join(wanted, ["class_id", "class_key"]).dropDuplicates(["class_id", "class_key"]).select("rep", "copies", "text").mapInArrow(_sets(n), "rep long, copies long, grams binary"))
    members = _in_blocks(need.join(sizes, "bucket")).join(sets, "rep").join(lists, "rep")
    keys = ["bucket", "one", "two"]
    return written(members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(parts, whole), "a long, b long, links long, even long, odd long, both long"))


def measured(links: DataFrame) -> float:
    """Recall of the runs, from the links of small leaves that the even and the odd ones caught; 1 if there are none."""
    even, odd, both = links.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("even", "odd", "both"))).first()
    if even + odd == both:
        return 1.0
    return 1 - (1 - both / max(1, odd)) * (1 - both / max(1, even))


def join_similar(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10), recall: float = 0.9999) -> DataFrame:
    """doc_id, text_key, class_id, component_id, n_links, kept of each row of docs (columns doc_id, text).

    class_id: least id with the same set; component_id: least id that links reach; n_links: other rows linked
    directly, those of the same class too; kept: the row is the first of its component.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketched = written(docs.mapInArrow(*_sketches(n, kind)))
    classes = sketched.where(F.col("low").isNotNull() & F.col("doc_id").isNotNull()).groupBy("low", "high").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n_grams").alias("n_grams"), F.min("sketch").alias("sketch"))
    # Classes are told apart by both digests; from here on they go by a number that is written with them.
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "low", "high", F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("class_key"), "copies", "n_grams", "sketch"))
    runs = runs_for(recall, threshold[0] / threshold[1])
    while True:
        met = written(leaves(classes.select("rep", "sketch"), 0, runs, threshold[0] / threshold[1]))
        links = _links(classes.drop("low", "high"), docs, met, n, threshold)
        if measured(links) >= recall:
            break
        runs *= 2
        if runs > MOST_RUNS:
            raise RuntimeError("the recall that is asked for isn't reached")
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    # Numbers of components are least numbers of classes: labels go by class first, then by the least id in them.
    roots = written(components(links.select("a", "b")))
    ids = written(roots.join(classes.select(F.col("rep").alias("node"), F.struct("class_id", "class_key").alias("of")), "node").groupBy("root").agg(F.min("of").alias("least")))
    labels = roots.join(ids, "root").join(counts.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("rep"), F.col("least.class_id").alias("component_id"), F.col("least.class_key").alias("component_key"), "links")
    known = written(classes.select("rep", "low", "high", "class_id", "class_key", "copies").join(labels, "rep", "left"))
    rows = sketched.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("low")).alias("low"), "high").join(known, ["low", "high"], "left")
    component = F.coalesce("component_id", "class_id", "doc_id")
    # Of a component, the rows with its least id and that id's first text stay.
    first_text = F.col("text_key") == F.coalesce("component_key", "class_key")
    return rows.select(
        "doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        (F.col("rep").isNull() | ((F.col("doc_id") == component) & first_text)).alias("kept"),
    )


def keep_first(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10), recall: float = 0.9999) -> DataFrame:
    """docs with one row of each component, the one with the least id, and all columns."""
    own_id, own_key = free_names(docs, "kept_id", "kept_key")
    joined = written(join_similar(docs, n, threshold, recall).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct())
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(joined, docs["doc_id"].eqNullSafe(F.col(own_id)) & (key == F.col(own_key)), "left_semi")
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    linking = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    return kept.where(linking).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(~linking))


#: The rows of join_similar(documents) without text_key, by all pairs that share an n-gram; doc_id is unique.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) u(i) WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n, min(b) FILTER (same) AS m FROM pairs GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(links.m, d.doc_id)) AS class_id, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id, coalesce(links.n, 0)::BIGINT AS n_links,
  least(d.doc_id, coalesce(low.m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN links ON links.a = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""
