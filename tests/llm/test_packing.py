"""Packing: every id in one piece, sequences without gaps, little padding, checksums of the library's ids."""

import os
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from sluicegate.llm import packing  # noqa: E402
from sluicegate.llm.chunk_bpe import load_tokenizer  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def check_sequences(rows, size=1024):
    """Places are gapless and disjoint; returns ids and padding."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    total = padding = 0
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= size
        total += end
        padding += packing.padded(end, size) - end
    return total, padding


def check(rows, texts, size=1024):
    """``texts``: (doc_id, text) of all documents, whose ids are distinct."""
    tokenizer = load_tokenizer(PATH)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == {d for d, _ in texts}
    expected = 0
    for d, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
        expected += at
    total, padding = check_sequences(rows, size)
    assert total == expected
    assert padding == 0


def test_given_documents(spark):
    path = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = packing.op12_cutting_stock_packing(spark, path)
    assert got.columns == COLUMNS
    check(got.collect(), texts)
    # Cuts besides those at full sequences are made in a minority of the documents.
    full = sum(len(load_tokenizer(PATH).encode(t or "", add_special_tokens=False).ids) // 1024 + 1 for _, t in texts)
    assert got.count() < 5 * full


@pytest.mark.parametrize("size", [1024, 16])
def test_difficult_documents(spark, size):
    rows = [(i, r[1], 1, "x", [1], 5) for i, r in enumerate(brute.document_rows())]
    rows += [(-i, "word " * i, 1, "x", [1], 5) for i in range(1, 1500, 100)]
    rows += [(-9000, "<|endoftext|> a<|endoftext|>", 1, "x", [1], 5), (-9001, "lang " * 300_000, 1, "x", [1], 5)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, length int, part string, crcs array<int>, rank int").repartition(3)
    check(packing.packed(docs, size=size).collect(), [(r[0], r[1]) for r in rows], size)


def test_repeated_rows_are_documents(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (None, None), (2, "")], "doc_id long, text string")
    rows = packing.packed(docs).collect()
    tokens = 3 * 3 + 2
    assert check_sequences(rows) == (tokens, 0)
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 4


def test_empty_table(spark):
    got = packing.packed(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == COLUMNS and got.collect() == []


@pytest.mark.parametrize("text", [
    "a  b " * 50, "x  y  z \n\n q " * 40, "it's 12 34's  \t end " * 40, "<|endoftext|> <|endoftext|>" * 30, "漢字 かな " * 50,
    "nospace" * 60, " " * 300, "a\x1c b\x85 c  d " * 40])
def test_blocks_have_the_ids_of_the_text(text):
    tokenizer = load_tokenizer(PATH)
    parts = packing.blocks(text, 7)
    assert "".join(parts) == text
    ids = [i for p in parts for i in tokenizer.encode(p, add_special_tokens=False).ids]
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_ranks_have_the_ids_of_the_tokenizer():
    """Every code point beside letters, digits, marks, spaces, and long runs of one kind."""
    tokenizer, ranks = load_tokenizer(PATH), packing.encoding(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [f"a{c}b 1{c}2 {c}{c} .{c}! '{c}s  {c} x{c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    texts = [" ".join(texts[i:i + 500]) for i in range(0, len(texts), 500)]
    texts += [" " * 300_000, "ab" * 150_000, "<|endoftext|>x <|endof" * 50, "a" + "\n" * 5000 + "b", ""]
    for text, wanted in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ranks.encode(text, allowed_special="all") == wanted.ids


def laid_out(plan, histogram):
    """All places of a plan: (length, rank) -> its parts, each (sequence, offset, shift, size)."""
    parts = defaultdict(list)
    for length, low, high, each, sequence, offset in plan.whole:
        for rank in range(low, high):
            parts[length, rank].append((sequence + (rank - low) // each, offset + (rank - low) % each * length, 0, length))
    for length, low, high, _, shift, size, position in plan.cut:
        for rank in range(low, high):
            full, within = divmod(position + (rank - low) * size, plan.size)
            n = 0
            if full >= plan.bulk:
                n = max(k for k, start in enumerate(plan.ends) if start <= within)
                within -= plan.ends[n]
            parts[length, rank].append((plan.first + full + n, within, shift, size))
    assert set(parts) == {(x, r) for x, n in histogram.items() for r in range(n)}
    for (length, _), p in parts.items():
        at = 0
        for _, _, shift, size in sorted(p, key=lambda q: q[2]):
            assert shift == at
            at += size
        assert at == length
    return parts


@pytest.mark.parametrize("seed", range(8))
def test_plans_of_histograms(seed):
    rng = np.random.default_rng(seed)
    size = [32, 128, 1024, 1024][seed % 4]
    lengths = rng.choice(np.arange(1, size + 1), int(rng.integers(1, min(size, 120))), replace=False)
    histogram = {int(x): int(rng.integers(1, [2, 50][seed % 2])) for x in lengths}
    plan = packing.plan(histogram, size)
    parts = laid_out(plan, histogram)
    rows = [{"sequence_id": s, "offset": o, "length": n} for p in parts.values() for s, o, _, n in p]
    total, padding = check_sequences(rows, size)
    assert total == sum(x * n for x, n in histogram.items()) and padding == 0


def test_one_length_without_a_pattern():
    """700 leaves padding in every pattern: all pieces are cut, none is padded."""
    plan = packing.plan({700: 333})
    parts = laid_out(plan, {700: 333})
    assert check_sequences([{"sequence_id": s, "offset": o, "length": n} for p in parts.values() for s, o, _, n in p]) == (700 * 333, 0)


def test_columns_are_generated():
    """The greedy start wastes what the program's columns save: 6+6 leaves 4, with 2+2 nothing."""
    lengths, counts = np.array([2, 5, 6, 11]), np.array([400, 300, 100, 300])
    start, level = packing.first_patterns(lengths, counts, 16)
    used = packing.column_generation(lengths, counts, 16)
    held = np.zeros(4)
    cost = 0.0
    for pattern, x in used:
        assert x >= -1e-9
        for i, n in pattern.items():
            held[i] += n * x
        cost += x * packing.padded(sum(n * int(lengths[i]) for i, n in pattern.items()), 16)
    assert np.allclose(held, counts)
    first = sum(x * packing.padded(sum(n * int(lengths[i]) for i, n in p.items()), 16) for p, x in zip(start, level))
    assert (lengths * counts).sum() - 1e-6 <= cost <= first + 1e-6


def test_knapsack_against_brute_force():
    lengths, prices = np.array([3, 5, 7]), np.array([2.5, 5.2, 7.0])
    best, last = packing.best_fills(lengths, prices, 40)
    for total in range(41):
        want = max((a * 2.5 + b * 5.2 + c * 7.0 for a in range(14) for b in range(9) for c in range(6)
                    if 3 * a + 5 * b + 7 * c == total), default=-np.inf)
        assert best[total] == pytest.approx(want)
        if np.isfinite(want):
            assert sum(lengths[i] * n for i, n in packing.traced(last, lengths, total).items()) == total
