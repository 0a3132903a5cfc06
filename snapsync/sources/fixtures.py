"""Representative inputs, derived from the given tables by fixed rules, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapsync.functions.tables import read
from snapsync.sources.manifests import from_documents

SECOND, EPOCH = 1_000_000_000, 1704067200000000000


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(read(spark, sf_dir, "documents"))


def target_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the source with one tenth missing, cut, touched, changed."""
    kind = F.col("doc_id") % 10
    text = F.when(kind == 1, F.expr("substr(text, 1, CAST(floor(n_chars / 3) AS INT))")).when(kind == 3, F.expr("concat(translate(substr(text, 1, 200), 'ae', 'ea'), substr(text, 201))")).otherwise(F.col("text"))
    return source(spark, sf_dir).where(kind != 0).select("file_id", "rel_path", "doc_id", text.alias("text"), F.when(kind.isin(2, 3, 9), F.col("mtime_ns") + SECOND).otherwise(F.col("mtime_ns")).alias("mtime_ns"))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = [F.octet_length("text").cast("long").alias("file_size"), "mtime_ns", F.md5("text").alias("content_hash")]
    stale = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("stale/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("rel_path"), "text", F.lit(EPOCH).alias("mtime_ns"))
    return target_payload(spark, sf_dir).select("rel_path", *digest).unionByName(stale.select("rel_path", *digest))


def transfer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).where("doc_id % 20 = 1").select("file_id", F.floor(F.col("file_size") / 2).cast("long").alias("received_bytes"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("file_id"), F.concat(F.lit("o/"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("rel_path"),
        F.floor("o_totalprice").cast("long").alias("file_size"), (F.lit(EPOCH) + F.col("o_orderkey") * SECOND).alias("mtime_ns"),
    )


def path_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id").cast("string")
    forms = [F.lit(""), F.concat(F.lit("/abs/"), p), F.concat(F.lit("a/../"), p), F.concat(F.lit("a..b/"), p), F.concat(F.lit(".hidden/"), p), F.concat(F.lit("ok/"), p, F.lit(".html"))]
    return read(spark, sf_dir, "pages").select("page_id", F.get(F.array(*forms), (F.col("page_id") % 6).cast("int")).alias("rel_path"))


def extension_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["a/x.JPG", "a/x.tar.gz", "v1.zip/x", "a/x", "a/x.txt", "a/.pdf"]
    return read(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 6).cast("int")).alias("rel_path"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_shipdate").alias("ts"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (3 + F.col("user_id") % 4).alias("expected"), "ts", "event_id", "value")


def source_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source with every 25th file of no length."""
    docs = read(spark, sf_dir, "documents")
    return from_documents(docs.withColumn("text", F.when(F.col("doc_id") % 25 == 7, "").otherwise(F.col("text"))))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source as it is sent: every 50th path leads out of the folder, every other 50th digest is wrong."""
    kind = F.col("file_id") % 50
    path = F.when(kind == 7, F.concat(F.lit("../"), "rel_path")).otherwise(F.col("rel_path"))
    digest = F.when(kind == 8, F.md5("rel_path")).otherwise(F.md5("text"))
    return source(spark, sf_dir).select("file_id", path.alias("rel_path"), "mtime_ns", digest.alias("digest"), "text")


#: The same in SQL, as common table expressions.
SQL = {
    "src": """SELECT doc_id + 1 AS file_id, concat(source, '/', lang, '/', lpad(doc_id::VARCHAR, 8, '0'), '.txt') AS rel_path, strlen(text)::BIGINT AS file_size,
      1704067200000000000 + doc_id * 1000000000 AS mtime_ns, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE md5(text) END AS content_hash, doc_id, text, n_chars FROM documents""",
    "dst0": """SELECT file_id, rel_path, doc_id, CASE WHEN doc_id % 10 = 1 THEN substr(text, 1, floor(n_chars / 3)::INT) WHEN doc_id % 10 = 3 THEN concat(translate(substr(text, 1, 200), 'ae', 'ea'), substr(text, 201)) ELSE text END AS text,
      CASE WHEN doc_id % 10 IN (2, 3, 9) THEN mtime_ns + 1000000000 ELSE mtime_ns END AS mtime_ns FROM src WHERE doc_id % 10 <> 0""",
    "dst": """SELECT rel_path, strlen(text)::BIGINT AS file_size, mtime_ns, md5(text) AS content_hash FROM dst0 UNION ALL
      SELECT concat('stale/', item_id::VARCHAR, '.txt'), strlen(text)::BIGINT, 1704067200000000000, md5(text) FROM benchmark""",
    "tidx": "SELECT file_id, floor(file_size / 2)::BIGINT AS received_bytes FROM src WHERE doc_id % 20 = 1",
    "ofiles": """SELECT o_orderkey + 1 AS file_id, concat('o/', lpad(o_orderkey::VARCHAR, 10, '0')) AS rel_path, floor(o_totalprice)::BIGINT AS file_size, 1704067200000000000 + o_orderkey * 1000000000 AS mtime_ns FROM orders""",
    "paths": """SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('/abs/', page_id::VARCHAR) WHEN 2 THEN concat('a/../', page_id::VARCHAR) WHEN 3 THEN concat('a..b/', page_id::VARCHAR)
      WHEN 4 THEN concat('.hidden/', page_id::VARCHAR) ELSE concat('ok/', page_id::VARCHAR, '.html') END AS rel_path FROM pages""",
    "exts": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'a/x.JPG' WHEN 1 THEN 'a/x.tar.gz' WHEN 2 THEN 'v1.zip/x' WHEN 3 THEN 'a/x' WHEN 4 THEN 'a/x.txt' ELSE 'a/.pdf' END AS rel_path FROM part",
    "arr": "SELECT l_orderkey AS file_id, l_linenumber AS chunk_index, l_shipdate AS ts FROM lineitem",
    "parts": "SELECT user_id AS session_id, 3 + user_id % 4 AS expected, ts, event_id, value FROM events",
    "esrc": "SELECT file_id, doc_id % 25 = 7 OR file_size = 0 AS empty FROM src",
    "counted": "SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, (sum(value::DECIMAL(18,6)) OVER (PARTITION BY user_id ORDER BY ts, event_id))::DOUBLE AS c FROM events",
    "lay": "SELECT *, (sum(file_size) OVER (ORDER BY rel_path) - file_size)::BIGINT AS virtual_offset, row_number() OVER (ORDER BY rel_path) AS place FROM ofiles",
    "lanes": "SELECT (((place - 1) % 7) + 1)::INT AS lane, file_id, file_size, place, row_number() OVER (PARTITION BY (place - 1) % 7 ORDER BY place) AS i FROM lay",
    "spans": """SELECT c AS chunk_id, file_id, (greatest(virtual_offset, c * 1048576) - c * 1048576)::BIGINT AS chunk_rel, (greatest(virtual_offset, c * 1048576) - virtual_offset)::BIGINT AS file_offset,
      (least(virtual_offset + file_size, (c + 1) * 1048576) - greatest(virtual_offset, c * 1048576))::BIGINT AS length, file_size
      FROM lay, unnest(range(virtual_offset // 1048576, (virtual_offset + file_size - 1) // 1048576 + 1)) u(c) WHERE file_size > 0""",
    "done": "SELECT DISTINCT chunk_id FROM spans WHERE chunk_id % 3 <> 0",
    "w": """SELECT s.*, d.file_size AS dst_size, d.mtime_ns AS dst_mtime_ns, d.content_hash AS dst_hash,
      CASE WHEN d.file_size IS NULL OR d.file_size <> s.file_size THEN 0 WHEN s.mtime_ns = d.mtime_ns THEN NULL WHEN s.content_hash IS NULL THEN 1 WHEN s.content_hash = d.content_hash THEN NULL ELSE 2 END::INT AS reason,
      CASE WHEN d.file_size IS NULL OR d.file_size <> s.file_size THEN NULL WHEN s.mtime_ns = d.mtime_ns THEN 'mtime' WHEN s.content_hash = d.content_hash THEN 'digest' END AS skipped_by
      FROM src s LEFT JOIN dst d USING (rel_path)""",
    "plan": """SELECT p.*, CASE WHEN action = 'PARTIAL' THEN got ELSE 0 END::BIGINT AS resume_offset FROM (
      SELECT s.*, d.file_size AS dst_size, coalesce(t.received_bytes, 0) AS got, coalesce(d.file_size = s.file_size, false) AS same_size,
      CASE WHEN d.file_size IS NULL THEN 'FULL' WHEN d.file_size <> s.file_size AND coalesce(t.received_bytes, 0) > 0 AND coalesce(t.received_bytes, 0) < s.file_size THEN 'PARTIAL' WHEN d.file_size <> s.file_size THEN 'FULL'
           WHEN s.mtime_ns = d.mtime_ns OR coalesce(s.content_hash, md5(s.text)) = d.content_hash THEN 'SKIP' ELSE 'FULL' END AS action
      FROM src s LEFT JOIN dst d USING (rel_path) LEFT JOIN tidx t USING (file_id)) p""",
    "sblk": """SELECT file_id, i::INT AS chunk_index, array_slice(encode(text), (i * 1024 + 1)::BIGINT, ((i + 1) * 1024)::BIGINT) AS data FROM src, unnest(range(0, (strlen(text) + 1023) // 1024)) u(i)""",
    "dblk": """SELECT file_id, i::INT AS chunk_index, array_slice(encode(text), (i * 1024 + 1)::BIGINT, ((i + 1) * 1024)::BIGINT) AS data FROM dst0, unnest(range(0, (strlen(text) + 1023) // 1024)) u(i)""",
    "sdig": "SELECT file_id, chunk_index, octet_length(data)::BIGINT AS raw_len, md5(data) AS digest FROM sblk",
    "ddig": "SELECT file_id, chunk_index, octet_length(data)::BIGINT AS raw_len, md5(data) AS digest FROM dblk",
    "delta": "SELECT s.*, coalesce(s.digest <> d.digest, true) AS needed FROM sdig s LEFT JOIN ddig d USING (file_id, chunk_index)",
}
_USES = {"esrc": ["src"], "lanes": ["ofiles", "lay"], "dst0": ["src"], "dst": ["src", "dst0"], "tidx": ["src"], "lay": ["ofiles"], "spans": ["ofiles", "lay"], "done": ["ofiles", "lay", "spans"], "w": ["src", "dst0", "dst"], "plan": ["src", "dst0", "dst", "tidx"], "sblk": ["src"], "dblk": ["src", "dst0"], "sdig": ["src", "sblk"], "ddig": ["src", "dst0", "dblk"], "delta": ["src", "dst0", "sblk", "dblk", "sdig", "ddig"]}


def with_tables(names: str, select: str) -> str:
    """A statement over the named fixtures and those that they are made of."""
    wanted = {x for n in names.split() for x in [*_USES.get(n, []), n]}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n == 'lanes' else ''}({SQL[n]})" for n in SQL if n in wanted) + f"\n{select}"
