"""The conversation trie against plain Python and SQL."""

import hashlib
import random
import zlib

import pytest

from snapsync.llm import prefix_trie as P
from snapsync.llm import queries as Q
from tests.conftest import SF

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in held.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in who if len(seqs[c]) == len(p))))
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def some_rows(seed=3):
    pick = random.Random(seed)
    rows = []
    for c in [*range(-7, 30), 2**40]:
        turns = [(i if pick.random() < 0.8 else pick.choice([None, 1]), pick.choice(["user", "assistant", None]), pick.choice(["a", "é", "", None, "b b"])) for i in range(pick.randrange(1, 12))]
        rows += [(c, *t) for t in turns]
    return rows + [(None, 1, "user", "lost")] + [(50, 1, "user", "again")] * 4 + [(51, 1, "user", "again")] * 4


@pytest.mark.parametrize("width", [1, 2, 3, 8])
def test_equals_plain_python(spark, width):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert shown(P.prefix_trie(P.rebuilt(P.placed(df)), width)) == plain(rows)


def test_many_ends_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(P, "LISTED", 3)
    rows = [(c, t, "user", "same") for c in range(40) for t in range(2)] + some_rows()
    rows = [r for r in rows if r[0] is None or r[0] < 2**30]
    df = spark.createDataFrame(rows, SCHEMA)
    assert shown(P.prefix_trie(P.rebuilt(P.placed(df)))) == plain(rows)


def test_a_long_conversation_goes_on_in_further_blocks(spark):
    rows = [(0, t, "user", f"{t}") for t in range(150)] + [(1, t, "user", f"{t}" if t < 120 else "other") for t in range(130)]
    turns = P.placed(spark.createDataFrame(rows, SCHEMA).repartition(5))
    nodes = {(r.conv_id, r.depth): r for r in P.prefix_trie(turns, 4).collect()}
    assert len(nodes) == 1 + 150 + 10
    assert nodes[0, 0].n_leaves == 2 and nodes[0, 120].n_children == 2 and nodes[0, 121].n_convs == 1 and nodes[1, 121].parent_conv_id == 0
    assert nodes[0, 0].saved_tokens == sum(len(f"{t}") for t in range(120)) and nodes[0, 121].saved_tokens == 0


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.prefix_trie(P.rebuilt(P.placed(empty))).collect() == []
    rows = some_rows(5)
    more = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", block string, pos int")
    assert shown(P.prefix_trie(P.rebuilt(P.placed(more)))) == plain(rows)


def test_query_equals_sql(spark, same_rows):
    same_rows(Q.QUERIES["op12_prefix_trie"](spark, SF), Q.ORACLE_SQL["op12_prefix_trie"])
