"""Invariants of the snapshot operators on small inputs."""

import hashlib
import math
import pathlib
import random
import re
import shutil
import zlib
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapsync import queries as Q
from snapsync.functions import expressions as X
from snapsync.operators import bundles, chunks, layout, parts, report, resume, verify
from snapsync.plans import decisions as D
from snapsync.sources import fixtures as FX
from snapsync.sources import kept_trees as K
from snapsync.sources import manifests as M
from snapsync.streaming import streams
from tests.conftest import SF


def test_spans_tile_the_archive(spark):
    files = spark.createDataFrame([(1, "a", 0), (2, "b", 5), (3, "c", 12), (4, "d", 3)], "file_id long, rel_path string, file_size long")
    spans = layout.archive_spans(layout.virtual_layout(files), 4)
    cover = sorted((r.chunk_id * 4 + r.chunk_rel, r.length) for r in spans.collect())
    at = 0
    for start, length in cover:
        assert start == at
        at += length
    assert at == 20


def test_diff_with_itself_skips_all(spark):
    src = FX.source(spark, SF)
    assert D.want_files(src, src).where("reason IS NOT NULL").count() == 0


def test_token_ignores_order_and_partitions(spark):
    files = FX.order_files(spark, SF)
    assert M.token(files.repartition(7)).first() == M.token(files.orderBy(F.col("file_size"))).first()
    assert M.token(files).first().token != M.token(files.where("file_id > 1")).first().token


def test_bundle_limits(spark):
    rows = [(1, i, s, i) for i, s in enumerate([5, 6, 30, 4, 4, 4])]
    files = spark.createDataFrame(rows, "lane int, file_id long, file_size long, place long")
    after = {r.file_id: r.bundle_id for r in bundles.pack(files, True, 10, 3).collect()}
    before = {r.file_id: r.bundle_id for r in bundles.pack(files, False, 10, 3).collect()}
    assert after == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 2}
    assert before == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4}


def packed_one_by_one(sizes, close_after, most_bytes, most_files):
    bundle, held, n, out = 0, 0, 0, []
    for size in sizes:
        if not close_after and n and (held + size > most_bytes or n >= most_files):
            bundle, held, n = bundle + 1, 0, 0
        out.append(bundle)
        held, n = held + size, n + 1
        if close_after and (held >= most_bytes or n >= most_files):
            bundle, held, n = bundle + 1, 0, 0
    return out


@pytest.mark.parametrize("close_after", [True, False])
def test_bundles_over_blocks_equal_one_pass(spark, monkeypatch, close_after):
    monkeypatch.setattr(bundles, "BLOCK_FILES", 8)
    rng, lanes = random.Random(2), {}
    for lane, n in ((1, 131), (2, 64), (3, 5), (4, 9)):
        lanes[lane] = [rng.choice([0, 0, 1, 3, 5, 9, 30]) for _ in range(n)]
    rows = [(lane, 1000 * lane + i, x, 7 * i + lane) for lane, sizes in lanes.items() for i, x in enumerate(sizes)]
    files = spark.createDataFrame(rows, "lane int, file_id long, file_size long, place long").repartition(5)
    got = bundles.pack(files, close_after, 20, 6)
    assert "FlatMapGroupsInPandas [lane" in (plan := got._jdf.queryExecution().toString()) and "block" in plan
    want = {1000 * lane + i: b for lane, sizes in lanes.items() for i, b in enumerate(packed_one_by_one(sizes, close_after, 20, 6))}
    assert {r.file_id: r.bundle_id for r in got.collect()} == want
    assert bundles.pack(files.where("false"), close_after, 20, 6).count() == 0


def test_samples_and_ids_are_held_in_no_array(spark):
    for query in ("ewma_rate", "token_hit"):
        assert "collect_list" not in Q.QUERIES[query](spark, SF)._jdf.queryExecution().toString()


def test_weak_checksum_and_assembly(spark):
    docs = FX.source(spark, SF)
    blocks = chunks.chunk_digests(docs, 512, weak=True, data=True)
    assert all(r.weak == zlib.adler32(bytes(r.data)) for r in blocks.limit(50).collect())
    expected = docs.where("octet_length(text) > 0").select("file_id", F.md5("text").alias("digest"))
    assert {r.status for r in verify.verify_files(expected, verify.assemble(blocks.repartition(5))).collect()} == {"ok"}


def test_block_delta_has_all_files(spark):
    rows = {(r.file_id, r.chunk_index): r.needed for r in Q.QUERIES["block_delta_all"](spark, SF).collect()}
    docs = FX.source(spark, SF).select("file_id", "doc_id", "file_size", F.octet_length(F.expr("substr(text, 1, CAST(floor(n_chars / 3) AS INT))")).alias("cut")).collect()
    assert len(rows) == sum(-(-r.file_size // Q.BLOCK) for r in docs)
    for r in docs:
        needed = [rows[r.file_id, i] for i in range(-(-r.file_size // Q.BLOCK))]
        kind = r.doc_id % 10
        if kind == 0:
            assert all(needed)
        elif kind == 1:
            assert needed == [(i + 1) * Q.BLOCK > r.cut for i in range(len(needed))]
        elif kind != 3:
            assert not any(needed)


def test_empty_files_are_verified(spark, tmp_path):
    files = spark.createDataFrame([(1, ""), (2, "abc"), (3, "abc"), (4, "")], "file_id long, text string")
    got = verify.assemble(chunks.chunk_digests(files.where("file_id <> 3"), 2, data=True))
    expected = files.withColumn("digest", F.when(F.col("file_id") == 4, F.md5(F.lit("x"))).otherwise(F.md5("text")))
    sized = expected.withColumn("file_size", F.octet_length("text").cast("long"))
    assert {r.file_id: r.status for r in verify.verify_files(sized, got).collect()} == {1: "ok", 2: "ok", 3: "missing", 4: "mismatch"}
    assert {r.file_id: r.status for r in verify.verify_files(expected, got).collect()} == {1: "ok", 2: "ok", 3: "missing", 4: "missing"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.withColumn("text", F.when(F.col("doc_id") == 1, "").otherwise(F.col("text"))).write.parquet(str(tmp_path / "documents.parquet"))
    status = {r.file_id: r.status for r in Q.QUERIES["verify_files"](spark, str(tmp_path)).collect()}
    assert len(status) == docs.count() and status[2] == "ok"


def test_compression_profile_equals_plain_python(spark):
    blocks = chunks.chunk_digests(FX.source(spark, SF), Q.BLOCK, data=True).collect()
    sent = sum(r.raw_len if r.file_id % 4 == 0 else min(r.raw_len, len(zlib.compress(bytes(r.data), 1))) for r in blocks)
    got = Q.QUERIES["compression_profile"](spark, SF).first()
    assert (got.n_blocks, got.raw_bytes, got.sent_bytes) == (len(blocks), sum(r.raw_len for r in blocks), sent)


def test_the_first_id_of_a_root_holds(spark, tmp_path):
    rows = [("a", "later", "2024-01-02"), ("a", "first", "2024-01-01"), ("b", "only", "2024-01-03")]
    spark.createDataFrame(rows, "root string, source_id string, given_at string").withColumn("given_at", F.col("given_at").cast("timestamp")).write.parquet(str(tmp_path / "ids"))
    roots = spark.createDataFrame([("a",), ("b",)], "root string")
    assert {r.root: r.source_id for r in M.source_identity(spark, roots, str(tmp_path / "ids")).collect()} == {"a": "first", "b": "only"}


def test_runs_at_once_give_a_root_one_id(spark, tmp_path):
    """Eight runs over overlapping roots, all at once; what each was told is what holds later."""
    path, names = str(tmp_path / "ids"), [[f"r{i}" for i in range(k, k + 4)] for k in range(8)]
    ids = lambda roots: {r.root: r.source_id for r in M.source_identity(spark, spark.createDataFrame([(x,) for x in roots], "root string"), path).collect()}
    with ThreadPoolExecutor(8) as pool:
        told = list(pool.map(ids, names))
    later = ids([f"r{i}" for i in range(11)] + [None])
    assert all(given == {x: later[x] for x in roots} for given, roots in zip(told, names))
    assert len(later) == len(set(later.values())) == 11


def test_a_run_that_loses_its_claim_reads_the_winners_ids(spark, tmp_path, monkeypatch):
    path, real, rivals = str(tmp_path / "ids"), M._claimed, []
    ids = lambda *roots: {r.root: r.source_id for r in M.source_identity(spark, spark.createDataFrame([(x,) for x in roots], "root string"), path).collect()}

    def claimed(*args):
        monkeypatch.setattr(M, "_claimed", real)
        rivals.append(ids("b", "c"))
        won = real(*args)
        assert not won
        return won

    monkeypatch.setattr(M, "_claimed", claimed)
    ours = ids("a", "b")
    assert ours["b"] == rivals[0]["b"] and ids("a", "b", "c") == ours | rivals[0]


def test_ewma(spark):
    rows = [(1, f"2024-01-01 00:00:0{i}", b) for i, b in enumerate([10.0, 20.0, 40.0, 45.0])]
    samples = spark.createDataFrame(rows, "k long, ts string, bytes double").withColumn("ts", F.col("ts").cast("timestamp"))
    rate = report.ewma_rate(samples, "k", "ts", "bytes").first().rate
    assert abs(rate - (0.9 * (0.9 * 10 + 0.1 * 20) + 0.1 * 5)) < 1e-9


def smoothed_one_by_one(samples):
    last_t, last_c, rate, n = None, None, 0.0, 0
    for t, c in sorted((x for x in samples if x[0] is not None), key=lambda x: (x[0], x[1] is None, x[1])):
        t /= 1e6
        if last_t is None:
            last_t, last_c = t, c
        elif t - last_t >= 0.05:
            inst = None if c is None or last_c is None else (c - last_c) / (t - last_t)
            rate = inst if last_c == 0 or rate == 0 else None if inst is None or rate is None else 0.9 * rate + 0.1 * inst
            last_t, last_c, n = t, c, n + 1
    return rate, n


@pytest.mark.parametrize("block, few", [(16, 0), (50, 7), (1 << 16, 1 << 12)])
def test_rates_of_a_cut_key_equal_one_pass(spark, block, few):
    """Dense and sparse samples, repeated times, counters that stand still, start over or are unknown, odd keys."""
    rng, samples = random.Random(5), {None: [(None, 1.0)], "c": [(1_700_000_000_000_000, None)], "d": []}
    for k, n in (("a", 3000), ("b", 300), ("e", 40), ("f", 1)):
        t, c, samples[k] = 1_700_000_000_000_000, 0.0, []
        for i in range(n):
            t += rng.choice([0, 1, 900, 7_000, 49_999, 50_000, 50_001, 400_000])
            c = 0.0 if i and rng.random() < 0.004 else c + rng.choice([0, 0, 5, 80])
            samples[k].append((t, None if rng.random() < 0.003 else c))
    samples["d"] = [(t, 0.0) for t, _ in samples["b"]] + [(None, 3.0)]
    rows = [(k, t, c) for k, xs in samples.items() for t, c in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, us long, c double").select("k", F.timestamp_micros("us").alias("ts"), "c").repartition(3)
    got = {r.k: (r.rate, r.n_used) for r in report.ewma_rate(df, "k", "ts", "c", block, few).collect()}
    want = {k: smoothed_one_by_one(xs) for k, xs in samples.items()}
    assert {k: n for k, (_, n) in got.items()} == {k: n for k, (_, n) in want.items()}
    assert {k: r is None for k, (r, _) in got.items()} == {k: r is None for k, (r, _) in want.items()}
    assert all(r is None or math.isclose(r, want[k][0], rel_tol=1e-9, abs_tol=1e-12) for k, (r, _) in got.items())
    assert report.ewma_rate(df.where("false"), "k", "ts", "c").count() == 0


def test_blocks_of_a_hot_key_are_few_rows(spark):
    """One key's 20,000 samples over four tasks: what meets in the last task is a row a block, with few entries."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.timestamp_micros(F.col("id") * 20_000).alias("ts"), F.col("id").cast("double").alias("c"))
    seen = []
    real = report.folded
    report.folded = lambda rows, *a: seen.append(rows.cache()) or real(seen[-1], *a)
    try:
        rate, n = report.ewma_rate(df, "k", "ts", "c", 500, 100).select("rate", "n_used").first()
    finally:
        report.folded = real
    assert n == 6666 and math.isclose(rate, 50.0, rel_tol=1e-9)
    sizes = seen[0].select(F.size("ts").alias("n"), F.col("steps").isNotNull().alias("jumps")).collect()
    assert len(sizes) <= 48 and max(x.n for x in sizes if x.jumps) <= 4 and max(x.n for x in sizes) <= 100


def test_empty_tables(spark):
    files = FX.order_files(spark, SF).where("false")
    assert layout.virtual_layout(files).count() == 0
    assert M.token(files).first().n_files == 0
    assert resume.file_completion(layout.archive_spans(layout.virtual_layout(files), 4), spark.createDataFrame([], "chunk_id long")).count() == 0


def test_bytes_round_to_even(spark):
    assert spark.createDataFrame([(1152,)], "n long").select(X.format_bytes(F.col("n")).alias("s")).first().s == "1.12 KB"


def test_tree_round_trip(spark, tmp_path):
    docs = FX.source(spark, SF).where("doc_id < 20")
    root = tmp_path / "tree"
    verify.materialize(chunks.chunk_digests(docs, 256, data=True), docs, str(root))
    (root / ".snapsync").mkdir()
    (root / ".snapsync" / "control").write_bytes(b"x")
    seen = {r.rel_path: (r.file_size, r.content_hash) for r in M.scan_tree(spark, str(root), content=True).collect()}
    want = {r.rel_path: (r.file_size, r.h) for r in docs.select("rel_path", "file_size", F.md5("text").alias("h")).collect()}
    assert seen == want


def test_tree_has_empty_and_hidden_files(spark, tmp_path):
    (tmp_path / "full").write_bytes(b"x")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "_file").write_bytes(b"yy")
    (tmp_path / "loop").symlink_to(tmp_path)
    rows = {r.rel_path: r for r in M.scan_tree(spark, str(tmp_path), content=True).collect()}
    assert {k: (r.file_size, bytes(r.content)) for k, r in rows.items()} == {"full": (1, b"x"), "empty": (0, b""), ".hidden/_file": (2, b"yy")}
    assert rows["empty"].content_hash == "d41d8cd98f00b204e9800998ecf8427e"
    assert {r.rel_path for r in M.scan_tree(spark, str(tmp_path)).collect()} == set(rows)


def test_unsafe_paths_are_neither_planned_nor_written(spark, tmp_path):
    root = tmp_path / "root"
    (tmp_path / "away").mkdir()
    root.mkdir()
    (root / "link").symlink_to(tmp_path / "away")
    paths = {1: "ok/a", 2: str(tmp_path / "abs.txt"), 3: "../../up.txt", 4: "link/b", 5: "bad", 6: "ok/empty", 7: "."}
    files = spark.createDataFrame([(i, p, "abc" if i != 6 else "", 1_700_000_000_123_456_789) for i, p in paths.items()], "file_id long, rel_path string, text string, mtime_ns long")
    digests = files.withColumn("digest", F.when(F.col("file_id") == 5, "0").otherwise(F.md5("text")))
    got = {r.file_id: r.status for r in verify.materialize(chunks.chunk_digests(files, 2, data=True), digests, str(root)).collect()}
    assert got == {1: "written", 2: "unsafe", 3: "unsafe", 4: "unsafe", 5: "mismatch", 6: "written", 7: "unsafe"}
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["root/ok/a", "root/ok/empty"]
    assert (root / "ok/a").stat().st_mtime_ns == 1_700_000_000_123_456_789
    plan = D.sync_plan(files.withColumns({"file_size": F.length("text").cast("long"), "content_hash": F.md5("text")}), FX.target(spark, SF), FX.transfer_index(spark, SF))
    assert {r.file_id for r in plan.collect()} == {1, 4, 5, 6, 7}


def test_apply_then_diff_gives_no_wants(spark, tmp_path):
    docs = FX.source_with_empty(spark, SF)
    verify.materialize(chunks.chunk_digests(docs, 256, data=True), docs.withColumn("digest", F.md5("text")), str(tmp_path / "t"))
    there = M.scan_tree(spark, str(tmp_path / "t"), content=True)
    assert there.count() == docs.count()
    assert D.want_files(docs, there).where("reason IS NOT NULL").count() == 0


def test_four_attempts(spark):
    seen = []
    work = spark.createDataFrame([(1,), (2,)], "id long")
    done, left = resume.retry_failed(work, lambda rows, n: seen.append(n) or rows.withColumn("ok", (F.col("id") == 1) & (F.lit(n) == 3)), "id")
    assert seen == [0, 1, 2, 3] and [r.id for r in done.collect()] == [1] and [r.id for r in left.collect()] == [2]


def test_saved_manifest_and_identity(spark, tmp_path):
    files = FX.order_files(spark, SF)
    M.save_manifest(files, "one", str(tmp_path / "m"))
    M.save_manifest(files.where("file_id < 50"), "two", str(tmp_path / "m"))
    assert M.load_manifest(spark, "one", str(tmp_path / "m")).count() == files.count()
    assert M.load_manifest(spark, "none", str(tmp_path / "m")) is None
    roots = spark.createDataFrame([("a",), ("b",), ("a",)], "root string")
    first = {r.root: r.source_id for r in M.source_identity(spark, roots, str(tmp_path / "ids")).collect()}
    again = {r.root: r.source_id for r in M.source_identity(spark, roots, str(tmp_path / "ids")).collect()}
    assert first == again and len(set(first.values())) == 2


def test_on_file_done_is_told_once(spark, tmp_path):
    got = []
    arrivals = streams.read_stream(spark, f"{SF}/lineitem.parquet").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("chunk_index"), F.lit(1).alias("needed"))
    streams.on_file_done(arrivals, lambda batch: got.extend(r.file_id for r in batch.collect()), str(tmp_path / "c")).awaitTermination()
    assert len(got) == len(set(got)) == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()


def test_materialize_refuses_gaps_repeated_paths_and_wrong_sizes(spark, tmp_path):
    files = [(1, "gap", None), (2, "late", None), (3, "a/b", None), (4, "a//b", None), (5, "none", None), (6, "empty", 0), (7, "short", 9), (8, "fine", 4), (9, "./a/b", None)]
    blocks = [(1, 0), (1, 2), (2, 1), (3, 0), (4, 0), (7, 0), (8, 0), (8, 1), (8, 1), (9, 0)]
    paths = spark.createDataFrame(files, "file_id long, rel_path string, file_size long")
    data = spark.createDataFrame([(f, i, bytes([48 + f, 48 + i])) for f, i in blocks], "file_id long, chunk_index int, data binary")
    got = {r.file_id: r.status for r in verify.materialize(data, paths, str(tmp_path / "tree")).collect()}
    assert got == {1: "incomplete", 2: "incomplete", 3: "written", 4: "repeated", 5: "missing", 6: "written", 7: "mismatch", 8: "written", 9: "repeated"}
    held = {str(p.relative_to(tmp_path / "tree")): p.read_bytes() for p in (tmp_path / "tree").rglob("*") if p.is_file()}
    assert held == {"a/b": b"30", "empty": b"", "fine": b"8081"}


def test_parts_are_written_by_many_tasks_and_checked(spark, tmp_path):
    """Whole and cut files, gaps inside and between parts, short and long blocks, repeats, sizes and digests that are off."""
    body = lambda f, n: b"".join(bytes([f, i, 0, 255]) for i in range(n))
    md5 = lambda x: hashlib.md5(x).hexdigest()
    full = {f: [(i, body(f, n)[4 * i : 4 * i + 4]) for i in range(n)] for f, n in ((1, 7), (2, 6), (3, 7), (4, 9), (5, 4), (6, 4), (7, 5), (8, 3), (9, 1), (10, 3), (13, 3), (14, 2), (15, 5))}
    full[1][-1] = (6, b"xy")
    full[3].pop(3), full[4].pop(-2), full[5].insert(1, full[5][1]), full[6].insert(1, (1, b"zzzz"))
    full[7][2] = (2, b"abc")
    full[8][1] = (1, b"abcde")
    full[13][1] = (1, None)
    full[99] = [(0, b"none")]
    paths = [(f, f"d{f % 3}/f{f}", None, None) for f in range(1, 11)] + [(11, "empty", 0, None), (12, "none", None, None), (13, "null", None, None), (14, "../out", None, None), (15, "digest", None, md5(body(15, 5))), (16, "nothing", None, md5(b""))]
    paths[1], paths[8], paths[9] = (2, "d2/f2", None, md5(b"?")), (9, "d0/f9", 5, None), (10, "d1/f10", 12, md5(body(10, 3)))
    blocks = spark.createDataFrame([(f, i, x) for f, rows in full.items() for i, x in rows], "file_id long, chunk_index int, data binary").repartition(7)
    root = tmp_path / "tree"
    root.mkdir()
    got = {r.file_id: r.status for r in parts.materialize_in_parts(blocks, spark.createDataFrame(paths, "file_id long, rel_path string, file_size long, digest string"), str(root), 4, 3).collect()}
    assert got == {1: "written", 2: "mismatch", 3: "incomplete", 4: "incomplete", 5: "written", 6: "incomplete", 7: "incomplete", 8: "incomplete", 9: "mismatch", 10: "written", 11: "written", 12: "missing", 13: "incomplete", 14: "unsafe", 15: "written", 16: "written"}
    held = {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}
    assert held == {"d1/f1": body(1, 6) + b"xy", "d2/f5": body(5, 4), "d1/f10": body(10, 3), "empty": b"", "digest": body(15, 5), "nothing": b""}
    none = spark.createDataFrame([], "file_id long, rel_path string")
    assert parts.materialize_in_parts(blocks.where("false"), none, str(root), 4).count() == 0


def test_tasks_that_run_again_find_what_was_moved(spark, tmp_path):
    """Settling a second time, as after a lost executor, gives the same statuses and leaves the files alone."""
    staging, names = str(tmp_path / "s"), ["file_id", "part", "n_bytes", "right", "full", "digest"]
    rows = pa.RecordBatch.from_pylist([{"file_id": 1, "part": i // 2, "chunk_index": i, "data": b"abcd"} for i in range(4)])
    write = lambda: [b.to_pylist()[0] for b in parts._part_writer(staging, 4, 2, names)([rows])]
    assert write() == write()
    file = pa.RecordBatch.from_pylist([{"file_id": 1, "rel_path": "a/b", "digest": hashlib.md5(b"abcd" * 4).hexdigest(), "file_size": 16, "mtime_ns": 5, "n_parts": 2, "n_bytes": 16, "one": "x", "whole": True}])
    settle = lambda: next(parts._settled(str(tmp_path), staging)([file]))["status"].to_pylist()
    assert settle() == settle() == ["written"] and (tmp_path / "a/b").read_bytes() == b"abcd" * 4


def test_ranges_of_files_and_those_that_changed(spark, tmp_path, monkeypatch):
    for name, data in (("a", b"0123456789"), ("d/b", b"abc"), ("gone", b"x" * 5), ("cut", b"y" * 8), ("empty", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    listed = M.scan_tree(spark, str(tmp_path)).collect()
    (tmp_path / "gone").unlink()
    (tmp_path / "cut").write_bytes(b"y")
    monkeypatch.setattr(M, "scan_tree", lambda s, root: s.createDataFrame(listed))
    rows = M.scan_ranges(spark, str(tmp_path), 4, content=True).collect()
    assert {(r.rel_path, r.chunk_index): (r.raw_len, r.data and bytes(r.data), r.error) for r in rows} == {
        ("a", 0): (4, b"0123", None), ("a", 1): (4, b"4567", None), ("a", 2): (2, b"89", None), ("d/b", 0): (3, b"abc", None),
        ("gone", 0): (None, None, "FileNotFoundError"), ("gone", 1): (None, None, "FileNotFoundError"), ("cut", 0): (None, None, "Changed"), ("cut", 1): (None, None, "Changed"),
    }
    assert all(r.digest == (None if r.error else hashlib.md5(bytes(r.data)).hexdigest()) for r in rows)


def test_digest_trees_tell_gaps_and_repeats(spark):
    rows = [(1, i, 2, f"d{i}") for i in range(20)] + [(2, 0, 2, "d0"), (2, 2, 2, "d2"), (3, 0, 2, "d0"), (3, 0, 2, "x"), (4, 0, 2, "d0"), (4, 0, 2, "d0"), (5, 1, 2, "d1")]
    blocks = spark.createDataFrame(rows, "file_id long, chunk_index int, raw_len long, digest string")
    got = {r.file_id: r for r in verify.file_digests(blocks.repartition(4), fan=3).collect()}
    assert {k: (r.whole, r.n_blocks, r.n_bytes) for k, r in got.items()} == {1: (True, 20, 40), 2: (False, 2, 4), 3: (False, 1, 2), 4: (True, 1, 2), 5: (False, 1, 2)}
    assert got[1].tree == verify.file_digests(blocks.where("file_id = 1"), fan=3).first().tree and len({r.tree for r in got.values()}) == 4
    # 28 blocks are beyond three levels of three.
    high = spark.createDataFrame([(1, i, 2, "d") for i in range(28)], blocks.schema)
    assert verify.file_digests(high, fan=3).first().tree is None
    expected = spark.createDataFrame([(1, got[1].tree, 40), (2, got[2].tree, 4), (4, "other", 2), (6, None, 5), (7, None, 0), (5, None, None)], "file_id long, tree string, file_size long")
    status = {r.file_id: r.status for r in verify.verify_blocks(expected, blocks, fan=3).collect()}
    assert status == {1: "ok", 2: "incomplete", 4: "mismatch", 6: "missing", 7: "ok", 5: "incomplete"}


@pytest.mark.parametrize("named", [0, 100])
def test_saved_trees_replace_scans_of_unchanged_sources(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(M, "NAMED", named)
    rows = spark.createDataFrame([(s, f"{s}/{i}", i) for s in "abc" for i in range(3)], "source_id string, rel_path string, file_size long")
    saved = spark.createDataFrame([("a", "1"), ("b", "1")], "source_id string, token string")
    M.save_trees(rows.where("source_id <> 'c'"), saved, str(tmp_path / "saved"))
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "source_id string, token string")
    asked = []
    changed = rows.withColumn("file_size", F.col("file_size") + 10)
    got = M.reused_trees(spark, now, str(tmp_path / "saved"), lambda wanted: asked.append(str(wanted)) or changed.where(wanted))
    assert sorted((r.rel_path, r.file_size, r.reused) for r in got.collect()) == sorted((f"{s}/{i}", i + 10 * (s != "a"), s == "a") for s in "abc" for i in range(3))
    if named:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "b" in asked[0] and "c" in asked[0] and "'a'" not in asked[0]
        assert re.search(r"PartitionFilters: \[[^]]*source_id#\d+ = a\)", plan)


def test_files_that_cannot_be_read_are_rows_with_an_error(spark, tmp_path, monkeypatch):
    """A file is listed, and gone or closed to readers when its content is asked for."""
    for name in ("here", "gone", "folder/there"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    listed = M.written
    monkeypatch.setattr(M, "written", lambda df: [listed(df), (tmp_path / "gone").unlink(missing_ok=True)][0])
    got = {r.rel_path: (r.content, r.error) for r in M.scan_tree(spark, str(tmp_path), content=True).collect()}
    assert got == {"here": (b"here", None), "folder/there": (b"folder/there", None), "gone": (None, "FileNotFoundError")}


def test_a_saved_manifest_of_any_size_loads_unless_told_otherwise(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}", 1, 1) for i in range(5)], "rel_path string, mtime_ns long, file_size long")
    M.save_manifest(rows, "s", str(tmp_path / "m"))
    assert M.load_manifest(spark, "s", str(tmp_path / "m")).count() == 5 and M.load_manifest(spark, "s", str(tmp_path / "m"), most_rows=4) is None


def test_kept_trees_read_and_write_few_folders(spark, tmp_path):
    files = spark.range(3000).select(F.concat(F.lit("f/"), "id").alias("rel_path"), F.col("id").alias("file_size"), F.lit(1).alias("mtime_ns"), F.lit("mine").alias("bucket"))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    K.save_tree(files, one)
    shutil.copytree(one, two)
    assert K.kept_token(spark, one).first() == M.token(files).first() and K.tree_changes(spark, one, two).count() == 0
    changes = spark.createDataFrame([("f/7", 0, 1, True), ("f/8", 99, 1, False), ("new", 5, 2, None), ("f/9", 9, 1, False), (None, 1, 1, False)], "rel_path string, file_size long, mtime_ns long, gone boolean")
    stamps = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "two" / "rows").glob("folder=*/*.parquet")}
    before = stamps()
    K.update_tree(spark, two, changes)
    assert len(before.keys() - stamps().keys()) <= 4  # folders of the changed paths
    now = files.where("file_size <> 7").withColumn("file_size", F.when(F.col("file_size") == 8, 99).otherwise(F.col("file_size"))).drop("bucket").unionByName(spark.createDataFrame([("new", 5, 2)], "rel_path string, file_size long, mtime_ns int"))
    assert K.kept_token(spark, two).first() == M.token(now).first() and K.kept_rows(spark, two).exceptAll(now).count() == 0
    # Folders of the same rows are not opened: the answer is the same when they are gone.
    used = {hashlib.md5(p.encode()).hexdigest()[:2] for p in ("f/7", "f/8", "new", "f/9")}
    for side in (one, two):
        for kind in ("rows", "buckets"):
            for folder in pathlib.Path(side, kind).glob("folder=*"):
                if folder.name[-2:] not in used:
                    shutil.rmtree(folder)
    assert sorted((r.rel_path, r.change, r.old_size, r.file_size) for r in K.tree_changes(spark, one, two).collect()) == [("f/7", "removed", 7, None), ("f/8", "changed", 8, 99), ("new", "added", None, 5)]
    K.update_tree(spark, two, changes)  # again: nothing more changes
    assert K.kept_token(spark, two).first().token == M.token(now).first().token


def test_kept_trees_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "rel_path string, file_size long, mtime_ns long")
    K.save_tree(none, str(tmp_path / "none"))
    K.save_tree(spark.createDataFrame([("a", 1, 1)], none.schema), str(tmp_path / "some"))
    assert K.kept_token(spark, str(tmp_path / "none")).first() == M.token(none).first()
    assert [r.change for r in K.tree_changes(spark, str(tmp_path / "some"), str(tmp_path / "none")).collect()] == ["removed"]
    K.update_tree(spark, str(tmp_path / "some"), spark.createDataFrame([("a", 1, 1, True)], "rel_path string, file_size long, mtime_ns long, gone boolean"))
    assert K.tree_changes(spark, str(tmp_path / "some"), str(tmp_path / "none")).count() == 0
    assert K.kept_token(spark, str(tmp_path / "some")).first() == M.token(none).first()


def test_tops_of_a_tree_are_summed_by_several_tasks(spark, tmp_path):
    """The one file of tops is written by one task, which doesn't read all buckets."""
    rows = spark.range(1000).selectExpr("concat('f', id) AS rel_path", "id AS file_size", "id AS mtime_ns")
    context, adaptive = spark.sparkContext, "spark.sql.adaptive.enabled"
    spark.conf.set(adaptive, "false")
    context.setJobGroup("tops", "tops")
    try:
        K.save_tree(rows, str(tmp_path / "tree"))
        jobs = context.statusTracker().getJobIdsForGroup("tops")
    finally:
        spark.conf.unset(adaptive)
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = sorted(context.statusTracker().getJobInfo(max(jobs)).stageIds)
    assert [context.statusTracker().getStageInfo(s).numTasks for s in stages[-2:]] == [4, 1] and len(stages) == 3


def test_ranges_of_a_batch_go_on_together(tmp_path):
    """Rows of ranges are joined again after reading; a file that is gone has an error for each."""
    (tmp_path / "a").write_bytes(b"0123456789")
    names, columns = ["rel_path", "file_size", "mtime_ns", "chunk_index"], [["a", "a", "a", "b", "b"], [10, 10, 10, 8, 8], [0] * 5, [0, 1, 2, 0, 1]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
    found = list(M._ranges(f"file://{tmp_path}", str(tmp_path), 4, True)(iter([batch])))
    assert len(found) == 1
    assert [(r["rel_path"], r["chunk_index"], r["raw_len"], r["data"], r["error"]) for r in found[0].to_pylist()] == [("a", 0, 4, b"0123", None), ("a", 1, 4, b"4567", None), ("a", 2, 2, b"89", None), ("b", 0, None, None, "FileNotFoundError"), ("b", 1, None, None, "FileNotFoundError")]
