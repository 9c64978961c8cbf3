"""Burst tries against a trie of tuples."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicegate.llm import burst_trie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes as rows of COLUMNS; ``rows`` have no equal turn numbers in a conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = own.get(c - int(np.fmod(c, 100)), [])
        paths[c] = tuple(first[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children, saved, leaves = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, ms in members.items():
        worth = (len(ms) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += worth
            leaves[p[:d]] += not children[p]
    return sorted((
        min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), children[p], leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in sorted(ms) if paths[c] == p).encode()).hexdigest())
        for p, ms in members.items()) if members else []


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", pos int, len int, seq string").repartition(4)
    got = burst_trie.prefix_trie(docs, **options)
    assert got.columns == burst_trie.COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def conversations(seed, blocks, size, words, most=9):
    rng = np.random.default_rng(seed)
    return [(int(b * 100 + c), int(t), ["user", "assistant", None][t % 3 if c % 7 else t % 2], f"w{rng.integers(words)}")
            for b in range(blocks) for c in range(size) for t in range(int(rng.integers(1, most)))]


@pytest.mark.parametrize("limit,levels", [(20_000, 4), (3, 1)])
def test_conversations(spark, limit, levels):
    check(spark, conversations(1, 3, 60, 3), limit=limit, levels=levels)


def test_difficult_conversations(spark):
    rows = conversations(2, 2, 20, 2, 5)
    rows += [(500 + i, 0, "user", "hot") for i in range(80)]  # one turn, or none of its own
    rows += [(700, None, None, None), (700, 0, "", ""), (701, 5, "user", "x" * 5000), (-205, 1, "user", "negative")]
    rows += [(-250, t, "user", f"w{t % 2}") for t in range(4)] + [(-200, t, "user", f"n{t}") for t in range(9)]
    rows += [(None, 0, "user", "of none"), (None, None, None, None)]
    rows += [(900, t, "user", f"long {t % 5}") for t in range(30)] + [(901, t, "user", f"long {t % 5}") for t in range(33)]
    check(spark, rows, limit=8)


def test_one_long_conversation_is_spread(spark):
    rows = [(4, t, "user", f"t{t}") for t in range(1500)] + [(5, t, "user", f"t{t}") for t in range(30)]
    check(spark, rows, limit=50)


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(burst_trie, "JOINED", 40)
    rows = [(c * 100, t, "user", f"t{t}") for c in range(300) for t in range(3)]
    check(spark, rows, limit=10)


def test_no_conversation(spark):
    assert burst_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert burst_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_only_turnless_conversations(spark):
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    check(spark, [(c, 0, "user", "a"), (c, 1, "user", "b")])


def test_running_values(spark):
    rng = np.random.default_rng(4)
    data = [(int(min(rng.integers(12), 3)), i, int(rng.integers(-2**62, 2**62)), int(rng.integers(50))) for i in range(3000)]
    df = spark.createDataFrame(data, "key long, turn long, a long, b long").repartition(5)
    got = burst_trie.running(df, "key", ["turn"], "place", {"a": "xa"}, {"b": "sb"}, "test")
    assert got.select("key").distinct().count() == 4
    state, want = {}, []
    for key, turn, a, b in data:
        place, xa, sb = state.get(key, (0, 0, 0))
        state[key] = place + 1, xa ^ a, sb + b
        want.append((key, turn, *state[key]))
    assert sorted(tuple(r) for r in got.select("key", "turn", "place", "xa", "sb").collect()) == sorted(want)
    assert got.where(F.col("key") == 3).count() > 2000
