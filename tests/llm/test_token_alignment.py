"""Token alignment against the libraries on whole texts and plain Python over byte ranges."""

import hashlib
from collections import Counter

import pytest

from snapsync.llm import queries as Q
from snapsync.llm import token_alignment as T
from tests.conftest import SF

PATHS = Q.tokenizer("byte_bpe_50k.json"), Q.tokenizer("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
ODD = [None, "", " ", "  two  spaces   x \n y\t z", "▁ mark", "a<|endoftext|>b </s> <s>", "\x00nul", "\n\n a  \n\n  b", "x" * 5000, "日本語 テスト　全角", "é  nb sp", "'s 't I'm don't", "a \u0085b", "\r\n c", "🙂 👨‍👩‍👧 x", "﻿bom x", " lead", "trail ", "<0x0A> b", "again and again and again", "again and again and again", "long " * 3000]


def plain(texts):
    """Rows without ids, by the libraries on whole texts and all pairs of overlapping ranges."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_of, b_of, pair = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1]), T._pair(*PATHS)
    a_of.encode_special_tokens = True
    docs = []
    for text in texts:
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        sides = []
        for ids, spell in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, ranges = 0, []
            for i in ids:
                ranges.append((i, at, at + len(spell[i])))
                at += len(spell[i])
            sides.append(ranges)
        if not text or any(b"".join(spell[i] for i in ids) != b" " + text.encode() for ids, spell in ((a, pair.bytes_a), (b, pair.bytes_b))):
            docs.append(None)
            continue
        links, groups, low = Counter(), [], 0
        first = 0
        for i, s, e in sides[0]:
            while sides[1][first][2] <= s:
                first += 1
            k = first
            while k < len(sides[1]) and sides[1][k][1] < e:
                links[i, sides[1][k][0]] += 1
                k += 1
        for cut in sorted({x[2] for x in sides[0]} & {x[2] for x in sides[1]}):
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in sides) if len(text) < 6000 else None)
            low = cut
        docs.append((len(a), len(b), links, groups))
    counts = Counter(p for d in docs if d for p in d[2])
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_best, total = sum(m for p, m in d[2].items() if counts[p] == most[p[0]]), sum(m * counts[p] for p, m in d[2].items())
            out.append((d[0], d[1], len(d[3]), sum(d[2].values()), n_best, total, None if None in d[3] else hashlib.sha256(";".join(d[3]).encode()).hexdigest()))
    return out


def same(got, texts):
    for x, y in zip(got, plain(texts)):
        assert x[:6] == y[:6] and y[6] in (None, x[6])


def rows(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_equals_plain_python_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = {r[0]: r[1:] for r in rows(Q.QUERIES["op11_token_alignment"](spark, SF))}
    assert set(got) == set(texts)
    same([got[k] for k in sorted(texts)], [texts[k] for k in sorted(texts)])


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_odd_texts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(T, "BROADCAST", broadcast)
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(ODD)], "doc_id long, text string, pairs string").repartition(3)
    got = sorted(rows(T.align_tokens(docs, *PATHS)))
    assert len(got) == len(ODD)
    same([r[1:] for r in got], ODD)


def test_ids_are_rows_and_empty_tables_are_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = rows(T.align_tokens(docs, *PATHS))
    assert len(got) == 3 and len({r[1:] for r in got}) == 1 and got[0][6] == 3 * got[0][4]
    assert T.align_tokens(docs.limit(0), *PATHS).count() == 0


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "KEPT", 3)
    pair = T.Pair(*PATHS)
    texts = [f"word{i % 7} other{i % 5} more" for i in range(60)] * 2
    kept = [[x[:5] for x in pair.documents([t])] for t in texts]
    fresh = T.Pair(*PATHS)
    monkeypatch.setattr(T, "KEPT", 10**6)
    assert kept == [[x[:5] for x in fresh.documents([t])] for t in texts]
