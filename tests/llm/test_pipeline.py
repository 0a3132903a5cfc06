"""The pipeline, stage by stage, against plain Python over the same rows."""

import collections
import hashlib
import math

import duckdb
from pyspark.sql import functions as F

from snapsync.llm import pieces, quality_rules, queries
from snapsync.llm.common import table, written
from tests.conftest import SF
from tests.llm.test_personal_data import brute_force
from tests.llm.test_text_operators import brute_jaccard, roots_of

ODD = [(900001, None), (900002, ""), (900003, " \t\n"), (900004, "one two"), (None, "one two"), (900006, "word " * 3000), (900007, "x" * 20000), (900008, "é🎉中 " * 40)]


def poisson_copies(rows):
    counts = collections.Counter(r.source for r in rows)
    weights = {s: n**0.5 for s, n in counts.items()}
    out = collections.Counter()
    for r in rows:
        mean = weights[r.source] / sum(weights.values()) * len(rows) / counts[r.source]
        unit = int(hashlib.md5(f"mix|{'null' if r.doc_id is None else r.doc_id}|1".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-mean)
        k = 0
        while c < unit:
            k += 1
            p *= mean / k
            c += p
        out[r.doc_id, r.text] += k
    return +out


def test_stages_equal_plain_python(spark, tmp_path):
    import corpus_pipeline

    given = table(spark, SF, "documents")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], given.schema)
    df = written(given.unionByName(odd).withColumns({c: F.lit("mine") for c in ("row", "rep", "kept_id", "mentions", "cdf", "ids", "copy", "order_key")}))
    columns = df.columns
    stages = dict(corpus_pipeline.STAGES)
    df.write.parquet(str(tmp_path / "docs"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    kept = collections.Counter(i for i, ok in con.sql(f"SELECT doc_id, kept FROM ({quality_rules.SQL})").fetchall() if ok)

    good = written(stages["quality rules"](spark, df, SF))
    rows = good.collect()
    assert good.columns == columns and collections.Counter(r.doc_id for r in rows) == kept

    first = written(stages["near duplicates"](spark, good, SF))
    texts = {r.doc_id: r.text for r in rows}
    roots = roots_of(texts, brute_jaccard(texts))
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {i for i in texts if roots[i] == i}

    clean = written(stages["personal data"](spark, first, SF))
    before = first.orderBy("doc_id").collect()
    assert clean.columns == columns and [r.text for r in clean.orderBy("doc_id").collect()] == brute_force([r.text for r in before], queries.PII_KEY)

    mixed = written(stages["source mixing"](spark, clean, SF))
    assert mixed.columns == columns and collections.Counter((r.doc_id, r.text) for r in mixed.collect()) == poisson_copies(clean.collect())

    codec = pieces.codec(queries.tokenizer("piece_bpe_32k.model"))
    want = collections.Counter((r.doc_id, tuple(codec.vocabulary.encode_stream(pieces.MARK + r.text.replace(" ", pieces.MARK)))) for r in mixed.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in stages["encoding"](spark, mixed, SF).collect()) == want


def test_empty_table(spark):
    import corpus_pipeline

    df = table(spark, SF, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, SF))
        assert df.count() == 0, name
    assert df.columns == ["doc_id", "ids", "n_ids", "round_trip"]
