"""Packing of documents into sequences by cutting-stock column generation.

Each document's ids are followed by the id 0 and cut at every ``SIZE``; what remains at its end
is a piece shorter than a sequence, and the histogram of these lengths is the stock to be packed.
A pattern says how many pieces of each length share a sequence.  A linear program over patterns
asks for the fewest padded ids; its columns are generated by unbounded-knapsack dynamic programming,
which finds, for the program's prices of the lengths, the best pattern of every total.  The
program has a row per length and the driver sees only the histogram, at most ``SIZE`` numbers.

Patterns that leave no padding are rounded down and then up while the stock lasts; sequences that
subset-sum dynamic programming fills exactly take most of the rest.  Pieces left over are cut into
powers of two, which fill sequences without padding; the last sequences are powers of two
themselves and need none.  Documents of a length are ranked where they are tokenised, by prefix
sums of counts per task, and a rank range of a length goes to each place of a pattern.

A null text counts as empty: the id 0 alone.  Repeated rows are documents of their own, ids may
be null.  Long texts are given to the tokenizer in blocks cut before white space, where it
starts afresh anyway.  An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicegate.llm.base import slices, table, values, written
from sluicegate.llm.chunk_bpe import load_tokenizer

#: Ids of a sequence, and the id that ends a document.
SIZE, END = 1024, 0
#: Bytes of text that a task tokenises at a time, and characters of a block of a long text.
BATCH_BYTES, BLOCK = 2_000_000, 200_000
#: Share of padding at which the linear program is good enough; pricings, and columns that each may give.
GAP, ROUNDS, WIDE = 1e-6, 150, 24


# -- the plan, from a histogram --------------------------------------------------------------------

def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def best_fills(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each total up to ``size``: the largest sum of prices of lengths that add up to it
    (minus infinity if none do), and the index of one length of that choice."""
    best, last = np.full(size + 1, -np.inf), np.full(size + 1, -1)
    best[0] = 0.0
    for total in range(int(lengths[0]), size + 1):
        upto = np.searchsorted(lengths, total, side="right")
        worth = best[total - lengths[:upto]] + prices[:upto]
        pick = int(np.argmax(worth))
        best[total], last[total] = worth[pick], pick
    return best, last


def traced(last: np.ndarray, lengths: np.ndarray, total: int) -> dict[int, int]:
    """The pattern (index of a length: pieces) behind a total of ``best_fills``."""
    pattern: dict[int, int] = {}
    while total:
        pick = int(last[total])
        pattern[pick] = pattern.get(pick, 0) + 1
        total -= int(lengths[pick])
    return pattern


def padded(total: int, size: int) -> int:
    """Ids that a sequence of ``total`` ids takes: powers of two are not padded."""
    return total if total & (total - 1) == 0 else size


def exact_fill(lengths: np.ndarray, left: np.ndarray, first: int, total: int) -> dict[int, int] | None:
    """Pieces of the stock, one of them of the length ``first``, that add up to ``total``."""
    rest = total - int(lengths[first])
    if rest < 0:
        return None
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    by = np.full(rest + 1, -1)
    for i in range(len(lengths) - 1, -1, -1):  # large pieces first: small ones fill any gap later
        if reached[rest]:
            break
        length, most = int(lengths[i]), int(left[i]) - (i == first)
        front = np.flatnonzero(reached)
        for _ in range(min(most, rest // length)):
            front = front + length
            front = front[front <= rest]
            front = front[~reached[front]]
            if not len(front):
                break
            reached[front], by[front] = True, i
    if not reached[rest]:
        return None
    pattern = {first: 1}
    while rest:
        i = int(by[rest])
        pattern[i] = pattern.get(i, 0) + 1
        rest -= int(lengths[i])
    return pattern


def first_patterns(lengths: np.ndarray, counts: np.ndarray, size: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """A basis to start from: a pattern per length, and how often each is used.

    Exact fills are used as often as the stock lasts, in fractions, so each uses up at least one
    length and no later one holds it: the patterns are independent.
    """
    left = counts.astype(float)
    patterns: list[dict[int, int] | None] = [None] * len(lengths)
    level = np.zeros(len(lengths))
    for i in range(len(lengths) - 1, -1, -1):
        while patterns[i] is None:
            pattern = exact_fill(lengths, np.ceil(left - 1e-9), i, size) if left[i] > 1e-9 else None
            pattern = pattern or {i: size // int(lengths[i])}
            used = np.array(list(pattern))
            ratio = left[used] / np.array(list(pattern.values()))
            out = int(used[np.argmin(ratio)])
            patterns[out], level[out] = pattern, ratio.min()
            for j, n in pattern.items():
                left[j] -= n * level[out]
            left[out] = 0
            for j in used.tolist():  # used up at the same time: a column of its own, not used
                if left[j] <= 1e-9 and patterns[j] is None:
                    patterns[j], left[j] = {j: size // int(lengths[j])}, 0
    return patterns, level


def column_generation(lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often to use them, such that they hold the counts with least padding."""
    many = len(lengths)
    costs = np.array([padded(t, size) for t in range(size + 1)], float)
    patterns, level = first_patterns(lengths, counts, size)
    matrix = np.zeros((many, many))
    for j, pattern in enumerate(patterns):
        matrix[list(pattern), j] = list(pattern.values())
    cost = costs[(lengths @ matrix).astype(int)]
    inverse = np.linalg.inv(matrix)
    tokens = float((lengths * counts).sum())
    prices = cost @ inverse
    for _ in range(ROUNDS):
        if cost @ level <= (1 + GAP) * tokens:
            break
        best, last = best_fills(lengths, prices, size)
        gain = best - costs
        found = [(traced(last, lengths, int(t)), costs[t]) for t in np.argsort(-gain)[:WIDE] if gain[t] > 1e-6 * size]
        if not found:
            break
        columns, price = np.zeros((many, len(found))), np.array([c for _, c in found])
        for j, (pattern, _) in enumerate(found):
            columns[list(pattern), j] = list(pattern.values())
        while True:  # pivots, until none of these patterns is worth its ids
            gains = prices @ columns - price
            j = int(np.argmax(gains))
            if gains[j] <= 1e-6 * size:
                break
            column = inverse @ columns[:, j]
            ratio = np.where(column > 1e-9, level / np.where(column > 1e-9, column, 1), np.inf)
            out = int(np.argmin(ratio))
            if not np.isfinite(ratio[out]):
                price[j] = np.inf
                continue
            step, row = max(0.0, ratio[out]), inverse[out] / column[out]
            level = np.maximum(level - step * column, 0)
            column[out] = 0
            inverse -= np.outer(column, row)
            inverse[out], level[out] = row, step
            prices = prices - gains[j] * row
            patterns[out], cost[out] = found[j][0], price[j]
            price[j] = np.inf
        prices = cost @ inverse
    return list(zip(patterns, level.tolist()))


@dataclass
class Plan:
    """Where the pieces of each length go, by rank ranges.

    ``whole``: (length, low, high, each, sequence, offset): the piece of rank r is at place
    (r - low) % each of a run from ``offset`` in sequence + (r - low) // each.
    ``cut``: (length, low, high, part, shift, size, position): its part of ``size`` ids from
    ``shift`` on is at position + (r - low) * size of the row of sequences that starts with
    ``first``; ``ends`` are the beginnings of the last, shorter ones, after ``bulk`` full ones.
    """

    size: int
    whole: list[tuple] = field(default_factory=list)
    cut: list[tuple] = field(default_factory=list)
    first: int = 0
    bulk: int = 0
    ends: list[int] = field(default_factory=lambda: [0])


def _rounded(lengths: np.ndarray, counts: np.ndarray, size: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Patterns without padding, how often each is used, and the stock left over."""
    left = counts.astype(np.int64)
    used: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], most: int) -> None:
        times = min([most, *(int(left[i]) // n for i, n in pattern.items())])
        if times > 0:
            used.append((pattern, times))
            for i, n in pattern.items():
                left[i] -= n * times

    chosen = [(p, x) for p, x in column_generation(lengths, counts, size)
              if (t := sum(n * int(lengths[i]) for i, n in p.items())) == padded(t, size)]
    for pattern, x in chosen:
        take(pattern, int(x + 1e-6))
    for pattern, x in sorted(chosen, key=lambda c: -(c[1] % 1)):
        if x % 1 > 1e-6:
            take(pattern, 1)
    for i in range(len(lengths) - 1, -1, -1):
        while left[i] > 0:
            pattern = next((p for total in (size, size // 2, size // 4) if (p := exact_fill(lengths, left, i, total))), None)
            if pattern is None:
                break
            take(pattern, int(left.max()))
    return used, left


def plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """The packing of ``histogram`` (length: pieces) into sequences."""
    out = Plan(size)
    lengths = np.array(sorted(x for x, n in histogram.items() if n > 0 and x < size), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    if histogram.get(size):
        out.whole.append((size, 0, histogram[size], 1, 0, 0))
    sequence = histogram.get(size, 0)
    if not len(lengths):
        out.first = sequence
        return out
    used, left = _rounded(lengths, counts, size)
    rank = dict.fromkeys(range(len(lengths)), 0)
    for pattern, times in used:
        offset = 0
        for i, each in pattern.items():
            length = int(lengths[i])
            out.whole.append((length, rank[i], rank[i] + each * times, each, sequence, offset))
            rank[i] += each * times
            offset += each * length
        sequence += times
    out.first = sequence
    position = 0
    for part_size in (1 << b for b in range(size.bit_length() - 1, -1, -1)):  # large parts first: all stay aligned
        for i in np.flatnonzero(left).tolist():
            parts = powers(int(lengths[i]))
            if part_size in parts:
                at = parts.index(part_size)
                out.cut.append((int(lengths[i]), rank[i], rank[i] + int(left[i]), at, sum(parts[:at]), part_size, position))
                position += int(left[i]) * part_size
    out.bulk, rest = divmod(position, size)
    out.ends = [0]
    for p in powers(rest):
        out.ends.append(out.ends[-1] + p)
    out.ends = out.ends[:-1] or [0]
    return out


# -- tokens and their pieces ----------------------------------------------------------------------

_BEFORE_SPACE = re.compile(r"(?<=\S) ")


def blocks(text: str, most: int = BLOCK) -> list[str]:
    """A long text in pieces cut before a space that follows no white space: the pre-tokenizer's
    pieces end there, so ids of the blocks are ids of the text."""
    out, begin = [], 0
    while len(text) - begin > most:
        found = _BEFORE_SPACE.search(text, begin + most)
        if not found:
            break
        out.append(text[begin:found.start()])
        begin = found.start()
    return [*out, text[begin:]]


_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(path: str, ranks_path: str):
    """The byte-level tokenizer of ``path`` in the form of merge ranks, which have the same ids at a
    third of the time; its special tokens are those of ``path``."""
    import base64

    import public_tokenizers
    import tiktoken

    if (path, ranks_path) not in _ENCODINGS:
        special = {x.content: i for i, x in load_tokenizer(path).get_added_tokens_decoder().items()}
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[path, ranks_path] = tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODINGS[path, ranks_path]


def _ids(tokenizer, text: str) -> np.ndarray:
    """The ids of a text, the end id last."""
    return np.array([*(i for b in blocks(text) for i in tokenizer.encode(b, allowed_special="all")), END], "<u4")


_PIECES = "start long, length int, crc long, doc_tokens long, part int, place long, crcs array<long>"


def _tokenised(path: str, ranks_path: str, size: int):
    def run(batches):
        tokenizer, part = encoding(path, ranks_path), TaskContext.get().partitionId()
        seen = [0] * (size + 1)  # pieces of each length so far: the rank within the task
        for batch in batches:
            texts = values(batch.column("text"))
            for a, b in slices(texts, BATCH_BYTES):
                row, out = [], [[] for _ in range(7)]
                for i, text in enumerate(texts[a:b]):
                    ids = _ids(tokenizer, text.decode("utf-8", "replace"))
                    for start in range(0, len(ids), size):
                        piece = ids[start:start + size]
                        raw = piece.tobytes()
                        crcs, at = [], 0
                        for p in powers(len(piece)) if len(piece) < size else ():
                            crcs.append(zlib.crc32(raw[4 * at:4 * (at + p)]))
                            at += p
                        row.append(i)
                        for column, value in zip(out, (
                                start, len(piece), zlib.crc32(raw), len(ids), part, seen[len(piece)], crcs)):
                            column.append(value)
                        seen[len(piece)] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a).take(pa.array(row, pa.int64())),
                     *(pa.array(c, t) for c, t in zip(out, types))],
                    ["doc_id", "start", "length", "crc", "doc_tokens", "part", "place", "crcs"])

    return run


def _sequence(position: Column, done: Plan) -> tuple[Column, Column]:
    """Sequence and offset of a position in the row of sequences of cut pieces."""
    full = F.floor(position / F.lit(done.size)).cast("long")
    within = position - full * done.size
    starts = F.array(*[F.lit(x).cast("long") for x in done.ends])
    ended = F.size(F.filter(starts, lambda x: x <= within)) - 1
    last = full >= done.bulk
    return (
        F.lit(done.first).cast("long") + full + F.when(last, ended).otherwise(0),
        within - F.when(last, F.element_at(starts, ended + 1)).otherwise(0))


def packed(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, size: int = SIZE) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` and ``ranks_path`` are two files of one tokenizer, of ``tokenizers`` and of ``tiktoken``.
    """
    import public_tokenizers

    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pieces = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _tokenised(path or public_tokenizers.path("byte_bpe_50k.json"),
                   ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), size), f"doc_id {id_type}, {_PIECES}"), "packing-pieces")
    # Ranks over all tasks: what earlier tasks hold of a length, and the place within the task.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "packing-counts")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    done = plan(histogram, size)
    ranked = pieces.join(cells.select("length", "part", "before"), ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("place"))

    # The plan has a few rows for each of at most ``size`` lengths, whatever the documents.
    whole = F.broadcast(spark.createDataFrame(
        done.whole, "length int, low long, high long, each int, sequence long, at int").alias("whole"))
    cut = F.broadcast(spark.createDataFrame(
        done.cut, "length int, low long, high long, cut int, shift int, size int, position long").alias("cut"))
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    r = F.col("rank") - F.col("low")
    placed = ranked.join(whole, (ranked["length"] == F.col("whole.length")) & inside).select(
        "doc_id", "start", ranked["length"].cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens",
        (F.col("sequence") + F.floor(r / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (r % F.col("each")) * ranked["length"]).cast("long").alias("offset"))
    if not done.cut:
        return placed
    sequence, offset = _sequence(F.col("position") + r * F.col("size"), done)
    parts = ranked.join(cut, (ranked["length"] == F.col("cut.length")) & inside).select(
        "doc_id", (F.col("start") + F.col("shift")).alias("start"), F.col("size").cast("long").alias("length"),
        F.element_at("crcs", F.col("cut") + 1).alias("ids_crc32"), "doc_tokens",
        sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    return placed.union(parts)


def op12_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op12_cutting_stock_packing": op12_cutting_stock_packing}
SQL: dict[str, str] = {}
