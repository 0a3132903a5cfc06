"""The trie of all conversation prefixes, by Spark SQL's ROLLUP over columns of turn ids.

A turn is named by 128 bits of the SHA-256 of its role and text. A conversation becomes rows of a fixed number of turn
ids, one column for each place: its column blocks. ROLLUP over these columns gives all prefixes that end in a block at
once; grouping_id() tells their length. A block further on is grouped by the node that the blocks before it lead to as
well, so long conversations go on in further blocks; these nodes are named by doubling (a block takes over what the
block 1, 2, 4 ... places before it knows), and so are the sums over subtrees that reach into further blocks. The number
of joins grows with the logarithm of the longest conversation, and no conversation is one task's work.

Results for odd input: rows with a null conv_id belong to no conversation; null role or text counts as empty; turns of
one number stand in the order of role, then text, and repeated rows are turns like others; an empty table gives an
empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapsync.llm.common import written

#: Turn ids in a row; a block is rolled up at so many lengths.
WIDTH = 8
#: Members that end at a node and are listed in a cell; more are streamed in pieces of this size.
LISTED = 4096


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn (id, bytes) of each row of conversations (conv_id, turn, role, text), in order of turn.

    Rows are dealt out by ranges of the order and numbered within each; what ranges before hold of a conversation, one
    row for each range and conversation, gives the rest. So a conversation of any length is spread over tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    ranged = rows.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")).withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    name = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)
    numbered = written(ranged.select("part", "conv_id", F.row_number().over(inner).alias("n"), F.struct(name.alias("id"), F.octet_length("text").cast("long").alias("bytes")).alias("turn")))
    sizes = numbered.groupBy("conv_id", "part").agg(F.max("n").alias("held"))
    before = sizes.select("conv_id", "part", F.coalesce(F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(before.where("before > 0"), ["conv_id", "part"], "left").select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("n") - 1).alias("pos"), "turn")


def rebuilt(turns: DataFrame, block: int = 5, modulus: int = 9) -> DataFrame:
    """Conversations that share beginnings, made of placed turns: the first h turns of conversation c - c % block (all
    if it has fewer, none if there is none), then c's own after its first h; h is crc32(c) % modulus.

    A conversation that is left without turns has one row with pos and turn null.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % modulus
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = counts.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    lead = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("held")), "base", "left").withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
    lead = written(lead)
    own = turns.join(lead.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn")
    heads = turns.where(F.col("pos") < modulus - 1).withColumnRenamed("conv_id", "base")
    first = lead.select("conv_id", "base", "taken").join(heads, "base").where("pos < taken").select("conv_id", "pos", "turn")
    none = lead.where("taken = 0 AND n <= h").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"))
    return own.unionByName(first).unionByName(none)


def _blocks(turns: DataFrame, width: int) -> DataFrame:
    """conv_id, block, t0.. of each column block; prior and upto name the nodes before and at the block's last turn."""
    cells = [F.max(F.when(F.col("pos") % width == i, F.col("turn"))).alias(f"t{i}") for i in range(width)]
    blocks = turns.groupBy("conv_id", F.floor(F.coalesce("pos", F.lit(0)) / width).alias("block")).agg(*cells)
    blocks = written(blocks.withColumn("own", _digest(*(F.col(f"t{i}.id") for i in range(width)))))
    last, step = blocks.agg(F.max("block")).first()[0] or 0, 1
    chain = blocks.select("conv_id", "block", F.col("own").alias("upto"))
    while step <= last:
        back = chain.select("conv_id", (F.col("block") + step).alias("block"), F.col("upto").alias("before"))
        chain = written(chain.join(back, ["conv_id", "block"], "left").select("conv_id", "block", F.when(F.col("before").isNull(), F.col("upto")).otherwise(_digest(F.col("before"), F.col("upto"))).alias("upto")))
        step *= 2
    prior = chain.select("conv_id", (F.col("block") + 1).alias("block"), F.col("upto").alias("prior"))
    more = blocks.select("conv_id", (F.col("block") - 1).alias("block"), F.lit(True).alias("more")).where("block >= 0")
    joined = blocks.drop("own").join(chain, ["conv_id", "block"]).join(prior, ["conv_id", "block"], "left").join(more, ["conv_id", "block"], "left")
    return written(joined.withColumns({"prior": F.coalesce("prior", F.lit("")), "more": F.coalesce("more", F.lit(False))}))


def _key(width: int, length: Column | str, prior: str = "prior", upto: str = "upto") -> Column:
    """Name of the node that so many turns of a block lead to from the node before the block."""
    length = F.col(length) if isinstance(length, str) else length
    key = F.when(length == 0, F.col(prior)).when(length == width, F.col(upto))
    for n in range(1, width):
        key = key.when(length == n, _digest(F.col(prior), *(F.col(f"t{i}.id") for i in range(n))))
    return key


def _rollup(rows: DataFrame, width: int, *aggregates: str) -> DataFrame:
    """rows grouped by block, prior and all beginnings of the turn columns; length tells how many turns a row is for."""
    cells = ", ".join(f"t{i}" for i in range(width))
    return rows.sparkSession.sql(f"SELECT block, prior, {cells}, CAST({width} - bit_count(grouping_id()) AS INT) AS length, {', '.join(aggregates)} FROM {{rows}} GROUP BY block, prior, ROLLUP({cells})", rows=rows)


def _ends(blocks: DataFrame, width: int) -> DataFrame:
    """key, ends_sha256 of nodes at which conversations end."""
    length = sum((F.col(f"t{i}").isNotNull().cast("int") for i in range(width)), F.lit(0))
    ends = written(blocks.where("NOT more").select(_key(width, length).alias("key"), "conv_id"))
    sizes = written(ends.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    few = ends.join(sizes.where(F.col("n") <= LISTED), "key").groupBy("key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("conv_id")), ","), 256).alias("ends_sha256"))
    if sizes.where(F.col("n") > LISTED).isEmpty():
        return few

    def pieces(batches):
        """Comma-joined ids of runs of one key in rows sorted by key and id, each with its first id."""
        for batch in batches:
            keys, ids, out, start = batch["key"].to_pylist(), batch["conv_id"].to_pylist(), [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start] or i - start == LISTED:
                    out.append({"key": keys[start], "first": ids[start], "piece": ",".join(map(str, ids[start:i]))})
                    start = i
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("first", batch["conv_id"].type), ("piece", pa.string())]))

    def hashed(batches):
        """The digest of each key's pieces in order; only its state is held."""
        at, state = None, None
        for batch in batches:
            out = []
            for key, piece in zip(batch["key"].to_pylist(), batch["piece"].to_pylist()):
                if key == at:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append({"key": at, "ends_sha256": state.hexdigest()})
                    at, state = key, hashlib.sha256()
                state.update(piece.encode())
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("ends_sha256", pa.string())]))
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"key": at, "ends_sha256": state.hexdigest()}])

    kind = ends.schema["conv_id"].dataType.simpleString()
    many = ends.join(sizes.where(F.col("n") > LISTED), "key").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = many.mapInArrow(pieces, f"key string, first {kind}, piece string")
    return few.unionByName(cut.repartition("key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(hashed, "key string, ends_sha256 string"))


def _below(nodes: DataFrame) -> DataFrame:
    """key, more_leaves, more_saved: sums over all that further column blocks hold below a block's last node.

    A group is what one node has in the next block. Every round doubles how far up a group's sums have come.
    """
    groups = nodes.where("block > 0").groupBy(F.col("prior").alias("key")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    above = nodes.where("block > 0").select("key", F.col("prior").alias("up"))
    groups = written(groups.join(above, "key", "left"))
    while not groups.where("up IS NOT NULL").isEmpty():
        reach = groups.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = groups.select(F.col("key").alias("up"), F.col("up").alias("next"))
        groups = written(groups.join(reach, "key", "left").join(further, "up", "left").select("key", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    return groups.select("key", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))


def prefix_trie(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of the trie of turns (conv_id, pos, turn; pos null: a conversation without turns).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = _blocks(turns, width)
    found = _rollup(blocks, width, "min(conv_id) AS conv_id", "count(*) AS n_convs", "max(upto) AS upto")
    last = F.coalesce(*(F.when(F.col("length") == i + 1, F.col(f"t{i}")) for i in range(width)))
    # Conversations that end before a length have no turn there; in further blocks length 0 is the node before.
    found = found.where(last.isNotNull() | ((F.col("length") == 0) & (F.col("block") == 0)))
    parent = _key(width, F.col("length") - 1)
    nodes = written(found.withColumns({"key": _key(width, "length"), "parent": F.when(F.col("length") > 0, parent), "saved": (F.col("n_convs") - 1) * F.coalesce(last["bytes"], F.lit(0))}).drop("upto"))
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"), F.lit(0).cast("long").alias("leaf"))
    nodes = written(nodes.join(children, "key", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "leaf": F.coalesce("leaf", F.lit(1).cast("long"))}))
    whole = nodes
    if not nodes.where("block > 0").isEmpty():
        more = nodes.join(_below(nodes), "key", "left")
        whole = more.withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
    own = "min_by(struct(key, parent, conv_id, n_convs, n_children), length_) AS own"
    sums = _rollup(whole.withColumnRenamed("length", "length_"), width, "sum(leaf) AS n_leaves", "sum(saved) AS saved_tokens", own, "min(length_) AS first")
    # A prefix that is a node has its own row as the shortest one below it.
    sums = written(sums.where("first = length").select((F.col("block") * width + F.col("length")).alias("depth"), "n_leaves", "saved_tokens", "own.*"))
    parents = sums.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = sums.join(parents, "parent", "left").join(_ends(blocks, width), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: crc32 by its bits; then lists of turns, each of their beginnings a row, and sums over pairs of a node and one below it.
SQL = """WITH t AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(x ORDER BY i) AS own, xor(list_reduce(list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT), lambda h, b: list_reduce(range(1, 9), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(h, b)), 4294967295), 4294967295) % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, c.h), list_slice(c.own, c.h + 1, len(c.own))) AS seq FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
n AS (SELECT list_slice(seq, 1, d) AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = d), '') AS ends FROM r, unnest(range(0, len(seq) + 1)) u(d) GROUP BY ALL),
k AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.p[depth].text) END AS saved FROM n LEFT JOIN k USING (p)),
s AS (SELECT list_slice(p, 1, d) AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM m, unnest(range(0, depth + 1)) u(d) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (p) LEFT JOIN n q ON m.depth > 0 AND q.p = list_slice(m.p, 1, m.depth - 1)"""
