"""Near-duplicates among embeddings: all pairs of one label with a cosine at or above a threshold, by cover trees.

On the unit sphere a cosine of t is a distance of sqrt(2 - 2t), which is a metric. The vectors of a label (and length)
are the root of a tree, a ball of radius 2. Levels below have the radii RADII, each half the one before: in a node with
more than `LEAF` vectors some are drawn by hash and thinned until all stand further apart than the level's radius; a
vector within that radius of one of them moves into the nearest one's ball. A ball that gathers fewer than `LEAST`
vectors isn't worth a node; its vectors stay in the rest of their node, whose ball is the node's own. Pairs of nodes go
down the levels together, from (root, root); a pair whose centres are further apart than both covering radii and the
threshold can't hold a link and is dropped with all below it. Rests that are large to the end are cut into blocks.

The tree goes on inside each leaf, once: nested nets with the same halving radii, in which a centre of one level is one
of all below; every vector carries its centre of each level and its distance from it. A pair of leaves that is left is
one task's work: the same bound, with covering radii as measured, prunes their node pairs level by level down to single
vectors, whose cosines are exact, in double precision.

Where vectors have no structure, as with random ones in many dimensions, no ball gathers anything and every pair of
blocks of a label is compared: the rows are then the vectors times the blocks of their label.

Equal vectors of a label are one class. Pairs of leaves give counts of links and one link for each class to its local
group, never all pairs.

Results for odd input: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label or null id, link with nothing and are kept; tiny and huge components are scaled by powers of two, which changes no
cosine; vectors of different lengths don't link; rows that share id and vector are one class; ids and labels of any type
that has an order are taken; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapsync.llm.common import by_group, written
from snapsync.llm.components import components
from snapsync.llm.ngram_join import local_roots

LEAF, PIVOTS, LEAST, PART = 1500, 48, 96, 20_000
RADII = (1.0, 0.5, 0.25, 0.125)
#: Slack for rounding of distances; the cosines decide in the end.
_EPSILON = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ y.T))


def _thinned(units: np.ndarray, radius: float) -> np.ndarray:
    """Places of a net: the first of all, and each that is further than radius from those before."""
    gap, kept = _distances(units, units), []
    for i in range(len(units)):
        if not kept or gap[i, kept].min() > radius:
            kept.append(i)
    return np.array(kept)


def _to_pivots(radius: float):
    """The nearest pivot of a vector's node, if it is within the radius, and how far it is; pivots are the rows not `own`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, _), group in by_group(batches, ["node", "part"]):
            group = group.combine_chunks()
            units, reps, own = _matrix(group["unit"].combine_chunks()), group["rep"].to_numpy(), group["own"].to_numpy()
            drawn = np.flatnonzero(~own)
            drawn = drawn[np.argsort(reps[drawn])]
            pivots = drawn[_thinned(units[drawn], radius)] if len(drawn) else drawn
            units_own, reps_own = units[own], reps[own]
            for low in range(0, len(reps_own), 4096):
                unit, rep = units_own[low : low + 4096], reps_own[low : low + 4096]
                gap = _distances(unit, units[pivots]) if len(pivots) else np.full((len(rep), 1), np.inf)
                at = np.argmin(gap, axis=1)
                away = gap[np.arange(len(rep)), at]
                pivot = reps[pivots[at]] if len(pivots) else np.zeros(len(rep), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.full(len(rep), node, np.int64)), pa.array(pivot, mask=away > radius), pa.array(away)], ["rep", "node", "pivot", "away"])

    return run


def _distance(a: str, b: str):
    dot = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))


def _near(pairs: DataFrame, nodes: DataFrame, below: DataFrame, reach: float) -> DataFrame:
    """The pairs of what lies below pairs that may hold links; below: node, child; nodes: node, radius, unit of children."""
    for side in ("one", "two"):
        own = below.join(nodes.withColumnRenamed("node", "child"), "child").select(F.col("node").alias(side), F.col("child").alias(f"{side}_child"), F.col("radius").alias(f"{side}_radius"), F.col("unit").alias(f"{side}_unit"))
        pairs = pairs.join(own, side)
    near = F.coalesce(_distance("one_unit", "two_unit") <= F.col("one_radius") + F.col("two_radius") + reach + _EPSILON, F.lit(True))
    return pairs.where(near).select(F.least("one_child", "two_child").alias("one"), F.greatest("one_child", "two_child").alias("two")).distinct()


def leaf_pairs(classes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(rep, node) of all leaves, and the pairs (one, two) of leaves that may hold links; classes: rep, node, unit."""
    places, units = classes.select("rep", "node"), classes.select("rep", "unit")
    nodes = places.select("node").distinct().select("node", F.lit(2.0).alias("radius"), F.lit(None).cast("array<double>").alias("unit"))
    pairs = nodes.select(F.col("node").alias("one"), F.col("node").alias("two"))
    for level, radius in enumerate(RADII):
        sizes = written(places.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF))
        if sizes.isEmpty():
            break
        # A large node is looked at in parts, each with all of its pivots.
        parts = F.ceil(F.col("n") / PART).cast("int")
        large = places.join(sizes, "node").join(units, "rep")
        drawn = large.where(F.pmod(F.xxhash64(F.lit(level), "rep"), F.col("n")) < PIVOTS).select("node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "rep", "unit", F.lit(False).alias("own"))
        both = large.select("node", F.pmod(F.xxhash64(F.lit("part"), "rep"), parts).cast("int").alias("part"), "rep", "unit", F.lit(True).alias("own")).unionByName(drawn)
        moved = written(both.repartition("node", "part").sortWithinPartitions("node", "part").mapInArrow(_to_pivots(radius), "rep long, node long, pivot long, away double"))
        balls = moved.where("pivot IS NOT NULL").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).where(F.col("n") >= LEAST)
        balls = written(balls.join(units.withColumnRenamed("rep", "pivot"), "pivot").select("node", "pivot", F.xxhash64("node", "pivot").alias("child"), "radius", "unit"))
        if balls.isEmpty():
            continue
        rest = places.join(sizes.select("node"), "node", "left_anti").select("rep", "node")
        places = written(rest.unionByName(moved.join(balls.select("node", "pivot", "child"), ["node", "pivot"], "left").select("rep", F.coalesce("child", "node").alias("node"))))
        below = balls.select("node", "child").unionByName(nodes.select("node", F.col("node").alias("child")))
        nodes = written(nodes.unionByName(balls.select(F.col("child").alias("node"), "radius", "unit")))
        pairs = written(_near(pairs, nodes, below, reach))
    return _blocks(places, pairs)


def _blocks(places: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are still large, cut in blocks: (rep, node) and the pairs of blocks."""
    sizes = written(places.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / LEAF).cast("int").alias("blocks")))
    cut = places.join(sizes, "node").select("rep", F.xxhash64("node", F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("blocks")).cast("int")).alias("node"))
    for side in ("one", "two"):
        own = sizes.select(F.col("node").alias(side), F.explode(F.expr("sequence(0, blocks - 1)")).alias(f"{side}_block"))
        pairs = pairs.join(own, side)
    pairs = pairs.where("one <> two OR one_block <= two_block")
    return cut, pairs.select(F.xxhash64("one", "one_block").alias("one"), F.xxhash64("two", "two_block").alias("two"))


def nets(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, distance) of each unit vector on each level of a cover tree; a centre is one on all levels below."""
    gaps = _distances(x, x)
    np.fill_diagonal(gaps, 0.0)
    owner, before, centres, away = np.zeros(len(x), np.int64), np.zeros(len(x), bool), [], []
    for radius in RADII:
        mine, gap = np.full(len(x), -1), np.full(len(x), np.inf)
        for i in [*np.flatnonzero(before).tolist(), *np.flatnonzero(~before).tolist()]:
            if mine[i] == -1 or before[i]:
                take = (owner == owner[i]) & (gaps[i] <= radius) & (gaps[i] < gap)
                take[i] = True
                mine[take], gap[take] = i, gaps[i][take]
        centres.append(mine)
        away.append(gap)
        owner, before = mine, mine == np.arange(len(x))
    return np.stack(centres), np.stack(away)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither vanish nor overflow; cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each leaf in the order of rep, with their centres (places in that order) and distances on all levels."""
    for _, group in by_group(batches, ["node"]):
        group = group.combine_chunks()
        centres, away = nets(_units(_scaled(_matrix(group["vector"].combine_chunks()))))
        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1) * len(RADII), pa.int32()), pa.array(a.T.ravel()))
        columns = [group[c].combine_chunks() for c in ("rep", "node", "copies", "vector")]
        yield pa.RecordBatch.from_arrays([*columns, lists(centres.astype(np.int32)), lists(away)], ["rep", "node", "copies", "vector", "centres", "away"])


def _levels(centres: np.ndarray, away: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(centres, place of each one's parent among the centres of the level above, covering radius) from the top down."""
    out, above = [], np.zeros(1, np.int64)
    parents = np.zeros(centres.shape[1], np.int64)
    for mine, gap in zip(centres, away):
        own, place = np.unique(mine, return_inverse=True)
        cover = np.zeros(len(own))
        np.maximum.at(cover, place, gap)
        out.append((own, np.searchsorted(above, parents[own]), cover))
        above, parents = own, mine
    every = np.arange(centres.shape[1])
    out.append((every, np.searchsorted(above, parents), np.zeros(len(every))))
    return out


def dual_traversal(x: np.ndarray, x_tree: tuple[np.ndarray, np.ndarray], y: np.ndarray, y_tree: tuple[np.ndarray, np.ndarray], reach: float) -> tuple[np.ndarray, int]:
    """Matrix of the pairs of unit vectors that the bounds of their trees can't rule out, and distances computed."""
    alive, done = np.ones((1, 1), bool), 0
    for (ca, up_a, ra), (cb, up_b, rb) in zip(_levels(*x_tree), _levels(*y_tree)):
        below = alive[np.ix_(up_a, up_b)]
        rows, columns = np.flatnonzero(below.any(axis=1)), np.flatnonzero(below.any(axis=0))
        done += len(rows) * len(columns)
        near = _distances(x[ca[rows]], y[cb[columns]]) <= ra[rows][:, None] + rb[columns][None, :] + reach + _EPSILON
        alive = np.zeros_like(below)
        alive[np.ix_(rows, columns)] = below[np.ix_(rows, columns)] & near
    return alive, done


def _linked(threshold: float):
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, ["one", "two"]):
            group = group.combine_chunks()
            reps, copies, side = (group[c].to_numpy() for c in ("rep", "copies", "side"))
            x = _scaled(_matrix(group["vector"].combine_chunks()))
            lengths, unit = np.sqrt(np.einsum("ij,ij->i", x, x)), _units(x)
            tree = [_matrix(group[c].combine_chunks()).T for c in ("centres", "away")]
            parts = [np.flatnonzero(side == k) for k in (0, 1)] if side.any() else [np.arange(len(x))] * 2
            parts = [p[np.argsort(reps[p], kind="stable")] for p in parts]  # the order that centres count in
            (left, one), (right, two) = ((p, (tree[0][:, p].astype(np.int64), tree[1][:, p])) for p in parts)
            some, _ = dual_traversal(unit[left], one, unit[right], two, reach)
            a, b = np.nonzero(some)
            linked = np.zeros((len(left), len(right)), bool)
            for low in range(0, len(a), 100_000):
                i, j = left[a[low : low + 100_000]], right[b[low : low + 100_000]]
                linked[a[low : low + 100_000], b[low : low + 100_000]] = (np.einsum("ij,ij->i", x[i], x[j]) / (lengths[i] * lengths[j]) >= threshold) & (reps[i] != reps[j])
            if not linked.any():
                continue
            whole = np.zeros((len(x), len(x)), bool)
            whole[np.ix_(left, right)] |= linked
            whole[np.ix_(right, left)] |= linked.T
            root, met = local_roots(whole), whole.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(reps[met]), pa.array(reps[root[met]]), pa.array((whole.astype(np.float64) @ copies)[met].astype(np.int64))], ["a", "b", "links"])

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (columns vec_id, embedding, label)."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.when(usable, F.col("embedding")).alias("vector"))
    classes = rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    wide = F.transform("vector", lambda x: x.cast("double") / F.col("largest"))
    classes = classes.withColumn("largest", F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))).withColumn("wide", wide)
    norm = F.sqrt(F.aggregate("wide", F.lit(0.0), lambda s, x: s + x * x))
    classes = classes.withColumn("norm", norm).withColumn("unit", F.transform("wide", lambda x: x / F.col("norm"))).withColumn("node", F.xxhash64("label", F.size("vector")))
    classes = written(classes.drop("largest", "wide", "norm").withColumn("rep", F.monotonically_increasing_id()))
    places, pairs = leaf_pairs(classes.select("rep", "node", "unit"), float(np.sqrt(2 - 2 * threshold)))
    number = classes.schema["vector"].dataType.simpleString()
    members = places.join(classes.select("rep", "copies", "vector"), "rep").select("rep", "node", "copies", "vector")
    members = written(members.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(_trees, f"rep long, node long, copies long, vector {number}, centres array<int>, away array<double>"))
    pairs = written(pairs)
    columns = ("rep", "copies", "vector", "centres", "away")
    sides = [members.join(pairs.where("one = two" if same else "one <> two").withColumnRenamed(side, "node"), "node").select(F.col("node").alias(side), F.col("two" if side == "one" else "one") if not same else F.col("node").alias("two"), *columns, F.lit(int(side == "two")).alias("side")) for side, same in (("one", True), ("one", False), ("two", False))]
    held = sides[0].unionByName(sides[1]).unionByName(sides[2])
    links = written(held.repartition("one", "two").sortWithinPartitions("one", "two").mapInArrow(_linked(threshold), "a long, b long, links long"))
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    roots = written(components(links.select("a", "b")))
    ids = written(roots.join(classes.select(F.col("rep").alias("node"), "class_id"), "node").groupBy("root").agg(F.min("class_id").alias("component_id")))
    labels = roots.join(ids, "root").join(counts.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("rep"), "component_id", "links")
    known = written(classes.select("rep", "label", "vector", "class_id", "copies").join(labels, "rep", "left"))
    component = F.coalesce("component_id", "class_id", "vec_id")
    # Rows without an id are of no class, though their vector may be one.
    met = rows.join(known, ["label", "vector"], "left")
    return met.select("vec_id", (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: The rows of link_vectors(embeddings), by all pairs and a search from each vector.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(links.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(least.m, e.vec_id)) AS component_id, least(e.vec_id, coalesce(least.m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN links ON links.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id
"""
