"""The registered queries of the snapshot operators, with their SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapsync.functions import expressions as X
from snapsync.functions.tables import read, shared_folder
from snapsync.operators import bundles, chunks, layout, parts, report, resume, verify
from snapsync.plans import decisions as D
from snapsync.sources import fixtures as FX
from snapsync.sources import kept_trees as K
from snapsync.sources import manifests as M
from snapsync.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CHUNK, BLOCK = 1 << 20, 1024


def query(tables: str | None = None, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = FX.with_tables(tables, sql) if tables else sql
        return f

    return add


def _layout(s: SparkSession, d: str) -> DataFrame:
    return layout.virtual_layout(FX.order_files(s, d))


def _spans(s: SparkSession, d: str) -> DataFrame:
    return layout.archive_spans(_layout(s, d), CHUNK)


def _done(spans: DataFrame) -> DataFrame:
    return spans.where("chunk_id % 3 <> 0").select("chunk_id").distinct()


def _blocks(s: SparkSession, d: str, side: str, **options) -> DataFrame:
    return chunks.chunk_digests((FX.source if side == "source" else FX.target_payload)(s, d), BLOCK, **options)


@query("src", "SELECT file_id, rel_path FROM src WHERE string_split(rel_path, '/')[1] <> 'src3'")
def exclude_control_dir(s, d):
    return M.exclude_control_dir(FX.source(s, d), "src3").select("file_id", "rel_path")


@query("src", "SELECT file_id, rel_path, file_size, mtime_ns, content_hash FROM src")
def documents_manifest(s, d):
    return FX.source(s, d).select("file_id", "rel_path", "file_size", "mtime_ns", "content_hash")


@query("tidx src", "SELECT file_id, coalesce(received_bytes, 0)::BIGINT AS received_bytes FROM src LEFT JOIN (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN received_bytes + 1 ELSE received_bytes END AS received_bytes FROM tidx WHERE file_id % 5 <> 0) USING (file_id)")
def transfer_index(s, d):
    state = FX.transfer_index(s, d).withColumn("updated_at", F.lit(1))
    newer = state.where("file_id % 2 = 0").withColumn("received_bytes", F.col("received_bytes") + 1).withColumn("updated_at", F.lit(2))
    gone = state.where("file_id % 5 = 0").withColumn("received_bytes", F.lit(None).cast("long")).withColumn("updated_at", F.lit(3))
    now = D.upsert(state, newer.unionByName(gone))
    return FX.source(s, d).select("file_id").join(now, "file_id", "left").select("file_id", F.coalesce("received_bytes", F.lit(0)).alias("received_bytes"))


@query("ofiles", "SELECT rel_path, row_number() OVER (ORDER BY rel_path) AS file_id FROM ofiles")
def assign_file_id(s, d):
    return M.assign_file_id(FX.order_files(s, d)).select("rel_path", "file_id")


@query("ofiles", "SELECT file_id, file_size <= 200000 AS is_small FROM ofiles")
def classify_size(s, d):
    return FX.order_files(s, d).select("file_id", X.is_small(F.col("file_size"), 200_000).alias("is_small"))


_EXTS = ", ".join(f"'{x}'" for x in X.COMPRESSED)


@query("exts", f"SELECT p_partkey, rel_path, lower(regexp_extract(rel_path, '(\\.[^.]*)$', 1)) NOT IN ({_EXTS}) AS compress FROM exts")
def should_compress(s, d):
    return FX.extension_cases(s, d).withColumn("compress", X.should_compress(F.col("rel_path")))


@query("paths", "SELECT page_id, rel_path, CASE WHEN rel_path = '' THEN 'empty' WHEN regexp_matches(rel_path, '^[/\\\\]') THEN 'absolute' WHEN contains(rel_path, '..') THEN 'parent' END AS rejected FROM paths")
def safe_path(s, d):
    return D.quarantine(FX.path_cases(s, d))


@query("src", "SELECT file_id, content_hash IS NOT NULL AS has_hash FROM src")
def has_hash(s, d):
    return FX.source(s, d).select("file_id", F.col("content_hash").isNotNull().alias("has_hash"))


@query("ofiles", "SELECT file_id, (file_size + 65535) // 65536 AS n_chunks, CASE WHEN file_size = 0 THEN 0 ELSE file_size - ((file_size + 65535) // 65536 - 1) * 65536 END AS last_size FROM ofiles")
def chunk_count(s, d):
    size = F.col("file_size")
    return FX.order_files(s, d).select("file_id", X.chunk_count(size, 65536).alias("n_chunks"), X.last_chunk_size(size, 65536).alias("last_size"))


def _plan(s: SparkSession, d: str) -> DataFrame:
    return D.sync_plan(FX.source(s, d), FX.target(s, d), FX.transfer_index(s, d))


@query("plan", "SELECT file_id, action, resume_offset FROM plan")
def sync_plan(s, d):
    return _plan(s, d).select("file_id", "action", "resume_offset")


@query("plan", "SELECT file_id, rel_path FROM plan WHERE action <> 'SKIP'")
def drop_skipped(s, d):
    return D.drop_skipped(FX.source(s, d), _plan(s, d)).select("file_id", "rel_path")


@query("esrc", "SELECT file_id, 0::BIGINT AS chunks_needed, true AS complete FROM esrc WHERE empty")
def empty_files(s, d):
    """Files of no length need no chunk and are complete at once."""
    files = FX.source_with_empty(s, d)
    needed = X.chunk_count(F.col("file_size"), 65536).cast("long")
    blocks = chunks.chunk_digests(files, 65536).groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks_done"))
    return files.select("file_id", needed.alias("chunks_needed")).join(blocks, "file_id", "left").where("chunks_needed = 0").select("file_id", "chunks_needed", (F.coalesce("chunks_done", F.lit(0)) >= F.col("chunks_needed")).alias("complete"))


@query("src", "SELECT DISTINCT split_part(rel_path, '/', 1) AS source_id, CASE WHEN split_part(rel_path, '/', 1) IN (SELECT source FROM documents WHERE doc_id % 97 = 3) THEN 'resume' WHEN split_part(rel_path, '/', 1) IN (SELECT source FROM documents WHERE doc_id % 5 = 1) THEN 'incremental' ELSE 'full' END AS mode FROM src")
def choose_mode(s, d):
    docs = read(s, d, "documents").select("doc_id", F.col("source").alias("source_id"))
    return D.choose_mode(docs.select("source_id").distinct(), docs.where("doc_id % 97 = 3"), docs.where("doc_id % 5 = 1"))


@query("plan", "SELECT file_id, file_size FROM plan WHERE action = 'FULL' AND same_size AND file_size > 1000")
def delta_candidates(s, d):
    return D.delta_candidates(_plan(s, d), 1000).select("file_id", "file_size")


@query("w", "SELECT rel_path, file_size, dst_size, mtime_ns, dst_mtime_ns FROM w")
def manifest_diff(s, d):
    return D.manifest_diff(FX.source(s, d), FX.target(s, d)).select("rel_path", "file_size", "dst_size", "mtime_ns", "dst_mtime_ns")


@query("w", "SELECT reason, skipped_by, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM w GROUP BY ALL")
def want_files(s, d):
    return D.want_files(FX.source(s, d), FX.target(s, d)).groupBy("reason", "skipped_by").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))


@query("w dst0", "SELECT w.rel_path, md5(dst0.text) AS dst_digest FROM w JOIN dst0 USING (rel_path) WHERE w.dst_size = w.file_size AND w.mtime_ns <> w.dst_mtime_ns")
def hash_tiebreak(s, d):
    return D.hash_tiebreak(FX.source(s, d), FX.target(s, d), FX.target_payload(s, d))


@query("delta", "SELECT file_id, chunk_index, raw_len, needed FROM delta")
def block_delta(s, d):
    return chunks.block_delta(_blocks(s, d, "source"), _blocks(s, d, "target")).select("file_id", "chunk_index", "raw_len", "needed")


@query("delta", "SELECT file_id, chunk_index, raw_len, needed FROM delta")
def block_delta_all(s, d):
    """block_delta over all files: missing, cut, touched, changed and unchanged ones."""
    return chunks.block_delta(_blocks(s, d, "source"), _blocks(s, d, "target")).select("file_id", "chunk_index", "raw_len", "needed")


@query("sdig ddig", "SELECT s.file_id, s.chunk_index FROM sdig s WHERE NOT EXISTS (SELECT 1 FROM ddig t WHERE t.file_id = s.file_id AND t.chunk_index = s.chunk_index AND t.raw_len = s.raw_len AND t.digest = s.digest)")
def needed_chunks(s, d):
    return chunks.needed_chunks(_blocks(s, d, "source"), _blocks(s, d, "target")).select("file_id", "chunk_index")


@query("lay", "SELECT file_id, virtual_offset, place FROM lay")
def virtual_layout(s, d):
    return _layout(s, d).select("file_id", "virtual_offset", "place")


@query("spans", "SELECT chunk_id, file_id, file_offset, length FROM spans")
def archive_spans(s, d):
    return _spans(s, d).select("chunk_id", "file_id", "file_offset", "length")


@query("spans", "SELECT chunk_id, file_id, chunk_rel, file_offset, length FROM spans")
def scatter_map(s, d):
    return _spans(s, d).select("chunk_id", "file_id", "chunk_rel", "file_offset", "length")


@query("spans done", "SELECT count(DISTINCT chunk_id) AS n_chunks, sum(length)::BIGINT AS bytes, count(*) FILTER (file_offset + length = file_size) AS files_ended FROM spans WHERE chunk_id NOT IN (SELECT chunk_id FROM done)")
def skipped_chunks(s, d):
    spans = _spans(s, d)
    return layout.skipped_chunks(spans, _done(spans))


@query("ofiles", "SELECT o.file_id, f.rel_path, f.file_id IS NOT NULL AS known FROM (SELECT DISTINCT l_orderkey + 2 AS file_id FROM lineitem WHERE l_linenumber = 1) o LEFT JOIN ofiles f USING (file_id)")
def resolve_wants(s, d):
    wants = read(s, d, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") + 2).alias("file_id")).distinct()
    return D.resolve_wants(wants, FX.order_files(s, d)).select("file_id", "rel_path", "known")


@query("src dst", "SELECT rel_path, file_size FROM dst WHERE rel_path NOT IN (SELECT rel_path FROM src)")
def orphans(s, d):
    return D.orphans(FX.source(s, d), FX.target(s, d)).select("rel_path", "file_size")


@query(None, "SELECT source AS source_id, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS token, max(doc_id) % 2 = 0 AS hit FROM documents GROUP BY source")
def token_hit(s, d):
    tokens = M.id_tokens(read(s, d, "documents").select(F.col("source").alias("source_id"), "doc_id"), "source_id", "doc_id")
    cached = tokens.select("source_id", F.when(F.col("last") % 2 == 0, F.col("token")).otherwise("old").alias("token"))
    return D.token_hit(tokens.drop("last"), cached)


@query("w", "SELECT w.file_id, w.reason, reused FROM w JOIN (SELECT source, max(doc_id) % 2 = 0 AS reused FROM documents GROUP BY source) h ON h.source = split_part(w.rel_path, '/', 1)")
def reused_manifest(s, d):
    """Wants of sources of which every other is unchanged since its manifest was saved; the others are read anew."""
    files = FX.source(s, d).drop("text").withColumn("source_id", F.split("rel_path", "/")[0])
    trees, path = (f"{shared_folder(s)}/{n}-{uuid.uuid4().hex}" for n in ("trees", "saved"))
    files.write.partitionBy("source_id").parquet(trees)
    tokens = M.id_tokens(files, "source_id", "doc_id")
    M.save_trees(files, tokens.withColumn("token", F.when(F.col("last") % 2 == 0, F.col("token")).otherwise("old")), path)
    now = M.reused_trees(s, tokens, path, lambda wanted: s.read.parquet(trees).where(wanted))
    return D.want_files(now, FX.target(s, d)).select("file_id", "reason", "reused")


@query("ofiles", "SELECT count(*) AS files, sum(file_size)::BIGINT AS bytes FROM ofiles")
def tree_totals(s, d):
    return FX.order_files(s, d).agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))


@query("plan", "SELECT action, count(*) AS files, sum(file_size)::BIGINT AS bytes, sum(resume_offset)::BIGINT AS resumed FROM plan GROUP BY action")
def plan_summary(s, d):
    return _plan(s, d).groupBy("action").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.sum("resume_offset").alias("resumed"))


@query("w", "SELECT sum(CASE WHEN reason IS NULL THEN file_size ELSE 0 END)::BIGINT AS bytes_skipped, sum(CASE WHEN reason IS NOT NULL THEN file_size ELSE 0 END)::BIGINT AS bytes_wanted, sum(file_size)::BIGINT AS bytes_total FROM w")
def skip_and_want_bytes(s, d):
    part = lambda keep: F.sum(F.when(keep, F.col("file_size")).otherwise(0))
    return D.want_files(FX.source(s, d), FX.target(s, d)).agg(part(F.col("reason").isNull()).alias("bytes_skipped"), part(F.col("reason").isNotNull()).alias("bytes_wanted"), F.sum("file_size").alias("bytes_total"))


@query("ofiles", "SELECT md5(string_agg(d, '' ORDER BY b)) AS token, sum(n)::BIGINT AS n_files FROM (SELECT substr(b, 1, 3) AS b, md5(string_agg(d, '' ORDER BY b)) AS d, sum(n) AS n FROM (SELECT substr(md5(rel_path), 1, 6) AS b, md5(string_agg(md5(concat_ws(chr(0), rel_path, mtime_ns::VARCHAR, file_size::VARCHAR)), '' ORDER BY rel_path)) AS d, count(*) AS n FROM ofiles GROUP BY 1) GROUP BY 1)")
def tree_token(s, d):
    return M.token(FX.order_files(s, d))


@query("ofiles", ORACLE_SQL["tree_token"].split("\n")[-1])
def kept_tree_token(s, d):
    """The token of a tree that was saved with rows missing, wrong and too many, and brought up to date."""
    files, path = FX.order_files(s, d), f"{shared_folder(s)}/kept-{uuid.uuid4().hex}"
    number = F.col("file_id")
    K.save_tree(files.where(number % 700 != 3).withColumn("rel_path", F.when(number % 1100 == 5, F.concat("rel_path", F.lit("x"))).otherwise(F.col("rel_path"))), path)
    right = files.where((number % 700 == 3) | (number % 1100 == 5)).withColumn("gone", F.lit(False))
    wrong = files.where(number % 1100 == 5).withColumn("rel_path", F.concat("rel_path", F.lit("x"))).withColumn("gone", F.lit(True))
    K.update_tree(s, path, right.unionByName(wrong))
    return K.kept_token(s, path)


@query("src dst", "SELECT rel_path, CASE WHEN o.file_size IS NULL THEN 'added' WHEN n.file_size IS NULL THEN 'removed' ELSE 'changed' END AS change, o.file_size AS old_size, o.mtime_ns AS old_mtime_ns, n.file_size AS file_size, n.mtime_ns AS mtime_ns FROM dst o FULL JOIN src n USING (rel_path) WHERE o.file_size IS DISTINCT FROM n.file_size OR o.mtime_ns IS DISTINCT FROM n.mtime_ns")
def tree_changes(s, d):
    """What differs between the source and its copy, by two saved trees."""
    before, after = (f"{shared_folder(s)}/kept-{uuid.uuid4().hex}" for _ in range(2))
    K.save_tree(FX.target(s, d), before)
    K.save_tree(FX.source(s, d), after)
    return K.tree_changes(s, before, after)


@query("src", "SELECT file_id, md5(text) AS digest FROM src")
def file_digest(s, d):
    return FX.source(s, d).select("file_id", F.md5("text").alias("digest"))


@query("sdig", "SELECT * FROM sdig")
def chunk_digests(s, d):
    return _blocks(s, d, "source")


@query("sblk", "SELECT file_id, chunk_index, octet_length(data)::BIGINT AS raw_len, md5(data) AS digest, ((1 + list_sum(b)) % 65521 + 65536 * ((len(b) + list_sum(list_transform(b, lambda x, i: (len(b) - i + 1) * x))) % 65521))::BIGINT AS weak FROM (SELECT *, list_transform(range(1, octet_length(data) + 1), lambda i: ('0x' || hex(array_slice(data, i, i)))::BIGINT) AS b FROM sblk)")
def weak_checksums(s, d):
    return _blocks(s, d, "source", weak=True)


@query("lay", "SELECT file_id, CASE WHEN file_size = 0 THEN 0 ELSE (virtual_offset + file_size - 1) // 1048576 - virtual_offset // 1048576 + 1 END::BIGINT AS chunks_needed FROM lay")
def chunks_per_file(s, d):
    return layout.chunks_per_file(_layout(s, d), CHUNK)


@query("spans done", "SELECT file_id, count(*) AS chunks_needed, count(d.chunk_id) AS chunks_done, count(*) = count(d.chunk_id) AS complete FROM spans s LEFT JOIN done d USING (chunk_id) GROUP BY file_id")
def file_completion(s, d):
    spans = _spans(s, d)
    return resume.file_completion(spans, _done(spans))


@query("arr", "SELECT file_id, count(DISTINCT chunk_index) AS n_chunks, count(DISTINCT chunk_index) >= 1 + file_id % 4 AS complete FROM arr GROUP BY file_id")
def arrivals_completion(s, d):
    return resume.arrivals_completion(FX.arrivals(s, d), 1 + F.col("file_id") % 4)


@query("src", "SELECT file_id, CASE WHEN file_id % 7 = 0 THEN 'missing' WHEN file_id % 7 = 1 AND strlen(text) > 1024 THEN 'mismatch' ELSE 'ok' END AS status FROM src WHERE strlen(text) > 0")
def verify_files(s, d):
    expected = FX.source(s, d).select("file_id", "file_size", F.md5("text").alias("digest"))
    got = _blocks(s, d, "source", data=True).where("file_id % 7 <> 0 AND NOT (file_id % 7 = 1 AND chunk_index = 1)")
    return verify.verify_files(expected, verify.assemble(got))


def _tree_sql(blocks: str) -> str:
    """Digest trees of eight children a node and height 3."""
    for level in range(3):
        place, digest = ("chunk_index", "digest") if level == 0 else ("up", "d")
        blocks = f"SELECT file_id, {place} // 8 AS up, md5(string_agg({digest}, '' ORDER BY {place})) AS d{', count(*) AS n, sum(raw_len)::BIGINT AS b' if level == 0 else ', sum(n)::BIGINT AS n, sum(b)::BIGINT AS b'} FROM ({blocks}) GROUP BY ALL"
    return f"SELECT file_id, d AS tree, n AS n_blocks, b AS n_bytes, true AS whole FROM ({blocks})"


@query("sdig", _tree_sql("SELECT * FROM sdig"))
def file_digest_tree(s, d):
    return verify.file_digests(_blocks(s, d, "source"), fan=8)


@query("src", "SELECT file_id, CASE WHEN strlen(text) = 0 THEN 'ok' WHEN file_id % 7 = 0 THEN 'missing' WHEN file_id % 7 = 1 AND strlen(text) > 2048 THEN 'incomplete' WHEN file_id % 7 = 1 AND strlen(text) > 1024 THEN 'mismatch' WHEN file_id % 7 = 2 THEN 'mismatch' ELSE 'ok' END AS status FROM src")
def verify_by_blocks(s, d):
    """Trees of digests as they are sent against those of blocks that came: none, without the second, or another first."""
    sent = _blocks(s, d, "source")
    expected = FX.source(s, d).select("file_id", "file_size").join(verify.file_digests(sent, fan=8).select("file_id", "tree"), "file_id", "left")
    came = sent.where("file_id % 7 <> 0 AND NOT (file_id % 7 = 1 AND chunk_index = 1)")
    return verify.verify_blocks(expected, came.withColumn("digest", F.when(F.expr("file_id % 7 = 2 AND chunk_index = 0"), F.md5("digest")).otherwise(F.col("digest"))), fan=8)


@query("spans done", "SELECT count(d.chunk_id) AS chunks_done, count(*) - count(d.chunk_id) AS chunks_left, sum(CASE WHEN d.chunk_id IS NOT NULL THEN raw ELSE 0 END)::BIGINT AS bytes_done, 100.0::DOUBLE * sum(CASE WHEN d.chunk_id IS NOT NULL THEN raw ELSE 0 END)::BIGINT / sum(raw)::BIGINT AS percent FROM (SELECT chunk_id, sum(length)::BIGINT AS raw FROM spans GROUP BY chunk_id) c LEFT JOIN done d USING (chunk_id)")
def progress_summary(s, d):
    spans = _spans(s, d)
    return resume.progress_summary(layout.chunk_sizes(spans), _done(spans))


@query("w", "SELECT count(*) AS files_total, count(*) FILTER (reason IS NULL) AS files_skipped, sum(file_size)::BIGINT AS bytes_total, coalesce(sum(file_size) FILTER (reason IS NULL), 0)::BIGINT AS bytes_skipped, count(*) FILTER (reason IS NOT NULL) AS files_sent, coalesce(sum(file_size) FILTER (reason IS NOT NULL), 0)::BIGINT AS bytes_sent, coalesce(sum(file_size) FILTER (reason IS NOT NULL), 0) = 0 AS up_to_date FROM w")
def session_summary(s, d):
    return report.session_summary(D.want_files(FX.source(s, d), FX.target(s, d)).withColumn("skipped", F.col("reason").isNull()))


@query("delta", "SELECT file_id, sum(raw_len)::BIGINT AS bytes, sum(CASE WHEN needed THEN 0 ELSE raw_len END)::BIGINT AS bytes_saved FROM delta GROUP BY file_id")
def delta_savings(s, d):
    return chunks.delta_savings(chunks.block_delta(_blocks(s, d, "source"), _blocks(s, d, "target")))


@query()
def compression_profile(s, d):
    """Every fourth file has a name of a kind that is packed already; its blocks are sent as they are."""
    name = F.when(F.col("file_id") % 4 == 0, "a/x.zip").otherwise("a/x.txt")
    return chunks.compression_profile(_blocks(s, d, "source", data=True), X.should_compress(name))


@query("src", "SELECT bool_and(file_size >= 400) AS all_ok, count(*) FILTER (file_size < 400) AS errors FROM src")
def run_status(s, d):
    return verify.run_status(FX.source(s, d).select((F.col("file_size") >= 400).alias("ok")))


@query("src", "SELECT DISTINCT regexp_replace(rel_path, '/?[^/]*$', '') AS parent FROM src")
def distinct_parents(s, d):
    return FX.source(s, d).select(X.parent_dir(F.col("rel_path")).alias("parent")).distinct()


@query("lay", "SELECT file_id, (((place - 1) % 7) + 1)::INT AS lane FROM lay")
def round_robin_lanes(s, d):
    return layout.lanes(_layout(s, d), 8).select("file_id", "lane")


def _packed_sql(closed: str) -> str:
    return f"""SELECT lane, bundle_id, file_id, file_size, place FROM (
WITH RECURSIVE r(lane, i, bundle_id, held, n, file_id, file_size, place) AS (
  SELECT lane, i, 0::BIGINT, file_size, 1, file_id, file_size, place FROM lanes WHERE i = 1
  UNION ALL
  SELECT l.lane, l.i, CASE WHEN {closed} THEN r.bundle_id + 1 ELSE r.bundle_id END, CASE WHEN {closed} THEN l.file_size ELSE r.held + l.file_size END, CASE WHEN {closed} THEN 1 ELSE r.n + 1 END, l.file_id, l.file_size, l.place
  FROM r JOIN lanes l ON l.lane = r.lane AND l.i = r.i + 1)
SELECT * FROM r)"""


@query("lanes", _packed_sql("r.held >= 4194304 OR r.n >= 64"))
def bundles_close_after(s, d):
    return bundles.pack(layout.lanes(_layout(s, d), 8), True, 4 << 20, 64)


@query("lanes", _packed_sql("r.held + l.file_size > 4194304 OR r.n >= 64"))
def bundles_close_before(s, d):
    return bundles.pack(layout.lanes(_layout(s, d), 8), False, 4 << 20, 64)


@query("src", "SELECT file_id, md5(text) AS digest, true AS ok FROM src")
def bundle_roundtrip(s, d):
    files = layout.lanes(layout.virtual_layout(FX.source(s, d).drop("text")), 8)
    back = bundles.read_bundles(bundles.write_bundles(bundles.pack(files, False, 1 << 20, 64), FX.source(s, d)))
    return back.select("file_id", F.md5("content").alias("digest"), "ok")


_COUNTER = "CAST(sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE)"


@query("counted", """SELECT user_id, rate, n_used FROM (
WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, c) AS i FROM counted),
r(user_id, i, t, c, rate, n_used) AS (
  SELECT user_id, i, t, c, 0.0::DOUBLE, 0 FROM o WHERE i = 1
  UNION ALL
  SELECT o.user_id, o.i, CASE WHEN o.t - r.t >= 0.05::DOUBLE THEN o.t ELSE r.t END, CASE WHEN o.t - r.t >= 0.05::DOUBLE THEN o.c ELSE r.c END,
    CASE WHEN o.t - r.t < 0.05::DOUBLE THEN r.rate WHEN r.c = 0 OR r.rate = 0 THEN (o.c - r.c) / (o.t - r.t) ELSE 0.9::DOUBLE * r.rate + 0.1::DOUBLE * ((o.c - r.c) / (o.t - r.t)) END,
    CASE WHEN o.t - r.t >= 0.05::DOUBLE THEN r.n_used + 1 ELSE r.n_used END
  FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, arg_max(rate, i) AS rate, arg_max(n_used, i) AS n_used FROM r GROUP BY user_id)""")
def ewma_rate(s, d):
    counted = read(s, d, "events").select("user_id", "ts", F.expr(_COUNTER).alias("bytes"))
    return report.ewma_rate(counted, "user_id", "ts", "bytes")


@query("ofiles", "SELECT file_id, CASE WHEN total = 0 THEN 0.0 ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE * done / total)) END AS percent, CASE WHEN total - done > 0 THEN floor((total - done)::DOUBLE / (1000 + file_id % 7)::DOUBLE)::BIGINT END AS eta_s FROM (SELECT file_id, file_size // 3 AS done, CASE WHEN file_id % 5 = 0 THEN 0 ELSE file_size END AS total FROM ofiles)")
def eta(s, d):
    total = F.when(F.col("file_id") % 5 == 0, 0).otherwise(F.col("file_size")).cast("long")
    rows = FX.order_files(s, d).select("file_id", F.expr("file_size div 3").alias("done"), total.alias("total"), (1000 + F.col("file_id") % 7).cast("double").alias("rate"))
    return report.eta(rows).select("file_id", "percent", "eta_s")


@query("src", "SELECT file_id, rel_path FROM src ORDER BY rel_path")
def order_by_path(s, d):
    return FX.source(s, d).select("file_id", "rel_path").orderBy("rel_path")


@query("lay", "SELECT file_id, virtual_offset FROM lay ORDER BY virtual_offset, file_id")
def order_by_offset(s, d):
    return _layout(s, d).select("file_id", "virtual_offset").orderBy("virtual_offset", "file_id")


@query("spans done", "SELECT DISTINCT chunk_id FROM spans WHERE chunk_id NOT IN (SELECT chunk_id FROM done) ORDER BY chunk_id")
def needed_sorted(s, d):
    spans = _spans(s, d)
    return resume.chunks_remaining(spans.select("chunk_id").distinct(), _done(spans)).orderBy("chunk_id")


@query("spans done", "SELECT DISTINCT chunk_id FROM spans WHERE chunk_id NOT IN (SELECT chunk_id FROM done) ORDER BY chunk_id LIMIT 100")
def bounded_run(s, d):
    return needed_sorted(s, d).limit(100)


@query("spans done", "SELECT DISTINCT chunk_id FROM spans EXCEPT SELECT chunk_id FROM done")
def chunks_remaining(s, d):
    spans = _spans(s, d)
    return resume.chunks_remaining(spans.select("chunk_id").distinct(), _done(spans))


@query("spans done", "SELECT chunk_id FROM spans WHERE chunk_id NOT IN (SELECT chunk_id FROM done) UNION SELECT chunk_id FROM spans WHERE file_id % 50 = 0")
def remark_corrupt(s, d):
    spans = _spans(s, d)
    left = resume.chunks_remaining(spans.select("chunk_id").distinct(), _done(spans))
    return resume.remark_corrupt(left, spans, FX.order_files(s, d).where("file_id % 50 = 0"))


@query("arr", "SELECT file_id, chunk_index, ts FROM (SELECT *, row_number() OVER (PARTITION BY file_id, chunk_index ORDER BY ts) AS n FROM arr) WHERE n = 1")
def dedupe_meta(s, d):
    return D.first_by(FX.arrivals(s, d), ["file_id", "chunk_index"], ["ts"])


@query("arr", "SELECT DISTINCT file_id, chunk_index FROM arr")
def dedupe_done(s, d):
    return FX.arrivals(s, d).select("file_id", "chunk_index").distinct()


@query("spans done", "SELECT chunk_id FROM done")
def progress_bitmap(s, d):
    return resume.from_bitmap(resume.to_bitmap(_done(_spans(s, d))))


@query("spans done", "SELECT DISTINCT chunk_id FROM spans EXCEPT SELECT chunk_id FROM done")
def resume_run(s, d):
    spans = _spans(s, d)
    now = M.token(FX.order_files(s, d)).select("token").crossJoin(F.broadcast(spans.agg(F.countDistinct("chunk_id").alias("total_chunks"))))
    saved = _done(spans).crossJoin(F.broadcast(now))
    stale = spans.select("chunk_id").distinct().withColumn("token", F.lit("other")).withColumn("total_chunks", F.lit(1).cast("long"))
    return resume.chunks_remaining(spans.select("chunk_id").distinct(), resume.valid_progress(saved.select("chunk_id", "token", "total_chunks").unionByName(stale), now))


@query("ofiles", "SELECT file_id, CASE WHEN file_id % 9 = 0 THEN 'failed' ELSE 'done' END AS status FROM ofiles")
def retry_failed(s, d):
    work = FX.order_files(s, d).select("file_id")
    done, left = resume.retry_failed(work, lambda rows, n: rows.withColumn("ok", (F.col("file_id") % 9 != 0) & ((F.col("file_id") % 3 == n) | (n == 2))), "file_id")
    return done.select("file_id", F.lit("done").alias("status")).unionByName(left.select("file_id", F.lit("failed").alias("status")))


def _human_sql(n: str) -> str:
    return f"CASE WHEN {n} < 1024 THEN concat({n}, ' B') WHEN {n} < 1048576 THEN printf('%.2f KB', {n} / 1024.0::DOUBLE) WHEN {n} < 1073741824 THEN printf('%.2f MB', {n} / 1048576.0::DOUBLE) ELSE printf('%.2f GB', {n} / 1073741824.0::DOUBLE) END"


@query("ofiles", f"SELECT file_id, {_human_sql('(file_size * (file_id % 9) * (file_id % 4000) // 100)')} AS shown FROM ofiles")
def format_bytes(s, d):
    return FX.order_files(s, d).select("file_id", X.format_bytes(F.expr("file_size * (file_id % 9) * (file_id % 4000) div 100")).alias("shown"))


@query("ofiles", "SELECT file_id, CASE WHEN r < 1024 THEN printf('%.1f B/s', r) WHEN r < 1048576 THEN printf('%.2f KB/s', r / 1024) ELSE printf('%.2f MB/s', r / 1048576) END AS shown FROM (SELECT file_id, (file_size * (file_id % 97) // 64)::DOUBLE AS r FROM ofiles)")
def format_speed(s, d):
    return FX.order_files(s, d).select("file_id", X.format_speed(F.expr("file_size * (file_id % 97) div 64").cast("double")).alias("shown"))


@query("ofiles", "SELECT file_id, CASE WHEN n < 60 THEN concat(n, 's') WHEN n < 3600 THEN concat(n // 60, 'm ', n % 60, 's') ELSE concat(n // 3600, 'h ', (n % 3600) // 60, 'm ', n % 60, 's') END AS shown FROM (SELECT file_id, (file_id * 37) % 9000 AS n FROM ofiles)")
def format_duration(s, d):
    return FX.order_files(s, d).select("file_id", X.format_duration((F.col("file_id") * 37) % 9000).alias("shown"))


@query("ofiles", "SELECT file_id, CASE WHEN t = 0 THEN '100%' ELSE concat(printf('%.1f', 100.0::DOUBLE * p / t), '%') END AS shown FROM (SELECT file_id, file_id % 8 AS p, (file_id % 3) * 8 AS t FROM ofiles)")
def format_percent(s, d):
    return FX.order_files(s, d).select("file_id", X.format_percent(F.col("file_id") % 8, (F.col("file_id") % 3) * 8).alias("shown"))


@query("ofiles", "SELECT file_id, mtime_ns // 100 + 116444736000000000 AS ticks, (mtime_ns // 100) * 100 AS back FROM ofiles")
def mtime_convert(s, d):
    ticks = X.ns_to_ticks(F.col("mtime_ns"))
    return FX.order_files(s, d).select("file_id", ticks.alias("ticks"), X.ticks_to_ns(ticks).alias("back"))


@query("parts", "SELECT session_id, max(expected) AS expected, CASE WHEN max(epoch_us(ts)) FILTER (n = expected) - min(epoch_us(ts)) <= 129600000000 THEN 'complete' ELSE 'expired' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM parts) GROUP BY session_id")
def group_parts(s, d):
    return report.group_parts(FX.parts(s, d), 129_600).select("session_id", "expected", "status")


@query(None, "SELECT user_id AS session_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR AND user_id % 3 <> 0")
def idle_gc(s, d):
    events = read(s, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    sessions = events.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_seen")).withColumn("done", F.col("session_id") % 3 == 0).crossJoin(F.broadcast(now))
    return report.idle_gc(sessions, F.col("now").cast("timestamp"), 12 * 3600).select("session_id", "last_seen")


@query("w", "SELECT file_id, reason, skipped_by FROM w")
def stream_wants(s, d):
    manifests = M.from_documents(streams.read_stream(s, f"{d}/documents.parquet"))
    return streams.run_to_table(streams.wants(manifests, FX.target(s, d)).select("file_id", "reason", "skipped_by"))


def _arrival_stream(s: SparkSession, d: str) -> DataFrame:
    return streams.read_stream(s, f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_shipdate").alias("ts"))


@query("arr", "SELECT file_id FROM arr GROUP BY file_id HAVING count(DISTINCT chunk_index) >= 1 + file_id % 4")
def stream_completion(s, d):
    return streams.run_to_table(streams.completion(_arrival_stream(s, d).withColumn("needed", 1 + F.col("file_id") % 4)), idle_batches=False).select("file_id")


@query("src", "SELECT file_id, runs FROM src, (VALUES ('same'), ('changed')) t(runs)")
def stream_resume_run(s, d):
    """Two runs under the token of the tree give each file once; under the token of a changed tree all come again."""
    folder = f"{shared_folder(s)}/runs-{uuid.uuid4().hex}"
    tree = FX.order_files(s, d)
    same, changed = (M.token(x).first().token for x in (tree, tree.withColumn("mtime_ns", F.col("mtime_ns") + 1)))
    run = lambda token: streams.resumed(M.from_documents(streams.read_stream(s, f"{d}/documents.parquet")).select("file_id"), folder, token)
    run(same)
    return run(same).withColumn("runs", F.lit("same")).unionByName(run(changed).withColumn("runs", F.lit("changed")))


@query("arr", "SELECT DISTINCT file_id, chunk_index FROM arr")
def stream_dedupe(s, d):
    return streams.run_to_table(streams.dedupe(_arrival_stream(s, d), delay="3650 days")).select("file_id", "chunk_index")


@query("src", "SELECT file_id, CASE WHEN file_id % 7 <> 0 OR strlen(text) = 0 THEN 'done' ELSE 'retry' END AS went_to FROM src")
def stream_split_verified(s, d):
    files = M.from_documents(streams.read_stream(s, f"{d}/documents.parquet"))
    sent = files.select("file_id", F.when(F.col("file_id") % 7 == 0, F.expr("substr(text, 2)")).otherwise(F.col("text")).alias("data"), F.md5("text").alias("digest"))
    base = f"{shared_folder(s)}/split-{uuid.uuid4().hex}"
    streams.split_verified(sent, f"{base}/done", f"{base}/retry", f"{base}/checkpoint")
    went = [s.read.parquet(f"{base}/{t}").select("file_id", F.lit(t).alias("went_to")) for t in ("done", "retry")]
    return went[0].unionByName(went[1])


@query("src", "SELECT file_id, file_id % 7 <> 0 OR strlen(text) = 0 AS ok FROM src")
def stream_verify(s, d):
    files = M.from_documents(streams.read_stream(s, f"{d}/documents.parquet"))
    sent = files.select("file_id", F.when(F.col("file_id") % 7 == 0, F.expr("substr(text, 2)")).otherwise(F.col("text")).alias("data"), F.md5("text").alias("digest"))
    return streams.run_to_table(streams.verified(sent).select("file_id", "ok"))


@query("parts", "SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, round(sum(value), 4) AS bytes FROM parts GROUP BY ALL")
def stream_throughput(s, d):
    events = streams.read_stream(s, f"{d}/events.parquet").select(F.col("user_id").alias("session_id"), "ts", "value")
    rows = streams.run_to_table(streams.throughput(events, "1 hour", "3650 days"), "update")
    last = D.first_by(rows, ["session_id", "start"], [F.col("batch_id").desc()])
    return last.select("session_id", F.col("start").cast("timestamp_ntz").alias("start"), F.round("bytes", 4).alias("bytes"))


@query("parts", "SELECT session_id, count(*) AS n FROM parts GROUP BY session_id")
def stream_group_parts(s, d):
    events = streams.read_stream(s, f"{d}/events.parquet").select(F.col("user_id").alias("session_id"), "ts")
    rows = streams.run_to_table(streams.group_parts(events, 30), "update")
    return D.first_by(rows, ["session_id"], [F.col("batch_id").desc()]).select("session_id", "n")


#: First and last sight, and what the watermark knows at the end of the table.
_LAST = "(SELECT max(epoch_us(ts)) FROM parts)"


@query("parts", f"SELECT * FROM (SELECT session_id, max(expected)::BIGINT AS expected, CASE WHEN max(epoch_us(ts)) FILTER (n = expected) - min(epoch_us(ts)) <= 129600000000 THEN 'complete' WHEN max(epoch_us(ts)) - min(epoch_us(ts)) > 129600000000 OR min(epoch_us(ts)) + 129600000000 < {_LAST} - 3600000000 THEN 'expired' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM parts) GROUP BY session_id) WHERE status IS NOT NULL")
def stream_timed_groups(s, d):
    events = streams.read_stream(s, f"{d}/events.parquet").select(F.col("user_id").alias("session_id"), (3 + F.col("user_id") % 4).alias("expected"), "ts")
    return streams.run_to_table(streams.timed_groups(events, 129_600, "1 hour"))


@query("parts", f"SELECT session_id, epoch_us(min(ts))::BIGINT AS first_seen, epoch_us(max(ts))::BIGINT AS last_seen FROM (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS stay FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) < 43200000000 THEN 0 ELSE 1 END AS new FROM parts)) GROUP BY session_id, stay HAVING max(epoch_us(ts)) + 43200000000 <= {_LAST} - 3600000000")
def stream_idle_sessions(s, d):
    events = streams.read_stream(s, f"{d}/events.parquet").select(F.col("user_id").alias("session_id"), "ts")
    rows = streams.run_to_table(streams.idle_sessions(events, 12 * 3600, "1 hour"))
    return rows.select("session_id", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"))


@query("parts", f"""SELECT session_id, round(list_reduce(list(bytes / 3600.0::DOUBLE ORDER BY start), lambda a, x: CASE WHEN a = 0 THEN x ELSE 0.9::DOUBLE * a + 0.1::DOUBLE * x END), 4) AS rate FROM (
SELECT session_id, start, coalesce(bytes, 0) AS bytes FROM (SELECT session_id, unnest(generate_series(min(start), max(start), INTERVAL 1 HOUR)) AS start FROM hours GROUP BY session_id) LEFT JOIN hours USING (session_id, start)) GROUP BY session_id""".replace("hours", f"(SELECT * FROM (SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, sum(value) AS bytes FROM parts GROUP BY 1, 2) WHERE epoch_us(start) + 3600000000 <= {_LAST} // 1000 * 1000 - 3600000000)"))
def stream_smoothed(s, d):
    """The smoothed rate of each session after the last hour that the watermark has closed."""
    events = streams.read_stream(s, f"{d}/events.parquet").select(F.col("user_id").alias("session_id"), "ts", "value")
    rates = streams.run_to_table(streams.smoothed(events, 3600, delay="1 hour"))
    return D.first_by(rates, ["session_id"], [F.col("start").desc()]).select("session_id", F.round("rate", 4).alias("rate"))


@query("ofiles", "SELECT rel_path, file_size, mtime_ns FROM ofiles")
def saved_manifest(s, d):
    path = f"{shared_folder(s)}/manifest-{uuid.uuid4().hex}"
    M.save_manifest(FX.order_files(s, d), "one", path)
    return M.load_manifest(s, "one", path).select("rel_path", "file_size", "mtime_ns")


@query(None, "SELECT DISTINCT source AS root, true AS kept, 32 AS length FROM documents")
def source_identity(s, d):
    """An id for each source; a second call gives the same ones."""
    roots, path = read(s, d, "documents").select(F.col("source").alias("root")).distinct(), f"{shared_folder(s)}/ids-{uuid.uuid4().hex}"
    first = M.source_identity(s, roots, path)
    again = M.source_identity(s, roots, path).withColumnRenamed("source_id", "again")
    return first.join(again, "root").select("root", (F.col("source_id") == F.col("again")).alias("kept"), F.length("source_id").alias("length"))


@query("spans done", "SELECT chunk_id FROM done")
def progress_table(s, d):
    """Progress saved under a layout's token, and read again; under another number of chunks there is none."""
    spans, path = _spans(s, d), f"{shared_folder(s)}/progress-{uuid.uuid4().hex}"
    total = spans.agg(F.max("chunk_id")).first()[0] + 1
    resume.save_progress(_done(spans), "t", total, path)
    return resume.load_progress(s, "t", total, path).unionByName(resume.load_progress(s, "t", total + 1, path))


def _folder(s: SparkSession) -> str:
    return f"{re.sub('^file:/+', '/', shared_folder(s))}/tree-{uuid.uuid4().hex}"


@query("src", "SELECT file_id, CASE file_id % 50 WHEN 7 THEN 'unsafe' WHEN 8 THEN 'mismatch' ELSE 'written' END AS status FROM src")
def materialize(s, d):
    files = FX.transfers(s, d)
    return verify.materialize(chunks.chunk_digests(files, BLOCK, data=True), files, _folder(s)).select("file_id", "status")


@query("src", "SELECT rel_path, file_size, mtime_ns, md5(text) AS content_hash FROM src")
def scan_tree(s, d):
    """The source written as files below a folder, and listed from there."""
    files, root = FX.source(s, d), _folder(s)
    verify.materialize(chunks.chunk_digests(files, BLOCK, data=True), files, root)
    return M.scan_tree(s, root, content=True).select("rel_path", "file_size", "mtime_ns", "content_hash")


@query("src", "SELECT file_id, CASE file_id % 50 WHEN 7 THEN 'unsafe' WHEN 8 THEN 'mismatch' ELSE 'written' END AS status FROM src")
def materialize_in_parts(s, d):
    """Files written by a task for every two blocks."""
    files = FX.transfers(s, d)
    return parts.materialize_in_parts(chunks.chunk_digests(files, BLOCK, data=True), files, _folder(s), BLOCK, 2).select("file_id", "status")


@query("src sdig", "SELECT rel_path, chunk_index::BIGINT AS chunk_index, raw_len, digest, NULL::VARCHAR AS error FROM sdig JOIN src USING (file_id)")
def scan_ranges(s, d):
    """The source written in parts below a folder, and read from there in ranges of a block."""
    files, root = FX.source(s, d), _folder(s)
    parts.materialize_in_parts(chunks.chunk_digests(files, BLOCK, data=True), files.select("file_id", "rel_path"), root, BLOCK, 2)
    return M.scan_ranges(s, root, BLOCK).select("rel_path", "chunk_index", "raw_len", "digest", "error")
