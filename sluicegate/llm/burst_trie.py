"""Prefix trie of conversations, built as burst tries.

A conversation is a sequence of turn ids (128 bits of hash of role and text), one row per turn.
Equal conversations are collapsed into one sequence with a weight.  At first all suffixes are in
one container under the root.  An oversized container (over ``LIMIT`` rows, of two sequences or
more) bursts: its node becomes a trie head and its suffixes move to containers by their next turn
id.  A round bursts ``LEVELS`` levels at once, later rounds more, each by one aggregation over the
rows of those levels.  Containers left are bounded: each is sorted in one task and swept into
nodes.  A container of one sequence needs no sweep, its nodes are its rows, however many.  Sums
over subtrees are taken in the sweep, and along the heads by doubling the distance looked down.

The position within a conversation and the hash of a prefix are running values over rows in range
partitions, so a long conversation is spread over tasks; what a task must know of earlier ones is a
row per task.

Null role or text is empty.  Turns of a conversation with equal numbers are ordered by a hash of
their content; a null number is the first.  Rows without a conv_id belong to no conversation.
A conversation whose turns all precede its own part is turnless and ends at the root.  An empty
table gives no rows, not even a root.  Other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicegate.llm.base import table, written

#: Rows that a container may hold; levels that the first round bursts.
LIMIT, LEVELS = 20_000, 4
#: Conversations of a block share the opening of its first one, up to OPENING - 1 turns.
BLOCK, OPENING = 100, 6
#: Characters of a block of joined ids.
JOINED = 1 << 20


# -- running values over range partitions ---------------------------------------------------------

def _running(columns: list[str], key: int, xors: list[int], sums: list[int], added: list[str]):
    """Adds the task, and per key the place and running xors and sums within the task."""
    def run(batches):
        part = TaskContext.get().partitionId()
        last, carry = None, [0] * (1 + len(xors) + len(sums))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            start = np.flatnonzero(np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]]))
            own = np.cumsum(np.isin(np.arange(len(keys)), start)) - 1  # -1: goes on from the batch before
            out = []
            for j, (kind, values) in enumerate(
                    [("sum", np.ones(len(keys), np.int64)), *(("xor", batch.column(c).to_numpy()) for c in xors),
                     *(("sum", batch.column(c).to_numpy()) for c in sums)]):
                total = np.bitwise_xor.accumulate(values) if kind == "xor" else np.cumsum(values)
                before = np.concatenate([[0], total])[start]
                base = np.append(before, carry[j])[own]  # own -1 takes the carry
                running = np.where(own < 0, total ^ base if kind == "xor" else total + base,
                                   total ^ base if kind == "xor" else total - base)
                carry[j] = int(running[-1])
                out.append(running)
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), part, np.int32)), *(pa.array(x.astype(np.int64)) for x in out)],
                [*columns, "part", *added])

    return run


def running(rows: DataFrame, key: str, order: list[str], place: str, xors: dict[str, str], sums: dict[str, str],
            label: str) -> DataFrame:
    """Rows with their place (from 1) within their key and running xors and sums (column: new name).

    Rows are dealt to range partitions of key and order, so a key with many rows is spread.
    """
    columns = rows.columns
    added = [place, *xors.values(), *sums.values()]
    first = [F.col(c).asc_nulls_first() for c in (key, *order)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["part int"] + [f"{a} long" for a in added])
    local = written(rows.repartitionByRange(*first).sortWithinPartitions(*first).mapInArrow(_running(
        columns, columns.index(key), [columns.index(c) for c in xors], [columns.index(c) for c in sums], added), schema), label)
    cells = local.groupBy(key, "part").agg(
        F.count(F.lit(1)).alias("c_0"), *[F.bit_xor(c).alias(f"c_{j + 1}") for j, c in enumerate(xors)],
        *[F.sum(c).alias(f"c_{j + 1 + len(xors)}") for j, c in enumerate(sums)])
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.bit_xor if 0 < j <= len(xors) else F.sum)(f"c_{j}").over(earlier).alias(f"b_{j}") for j in range(len(added))]
    # Only the key that a partition begins with can have rows in earlier ones: a row per partition.
    carried = F.broadcast(cells.select(key, "part", *before).where("b_0 > 0"))
    total = local.join(carried, [key, "part"], "left")
    values = [
        (F.col(a).bitwiseXOR(F.coalesce(f"b_{j}", F.lit(0))) if 0 < j <= len(xors) else F.col(a) + F.coalesce(f"b_{j}", F.lit(0))).alias(a)
        for j, a in enumerate(added)]
    return total.select(*columns, *values)


# -- conversations, rebuilt -----------------------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, i1, i2 (turn id), points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(F.lit(1), role, text).alias("i1"),
        F.xxhash64(F.lit(2), role, text).alias("i2"), F.char_length(text).cast("long").alias("points"))


def opening(conv: Column) -> Column:
    """Turns that a conversation takes from the first one of its block, at most."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(OPENING))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, len) of every conversation, and its rows: conv, len, pos (from 1), i1, i2, points."""
    numbered = written(running(rows, "conv", ["turn", "i1", "i2"], "k", {}, {}, "trie-turns").drop("turn"), "trie-numbered")
    sizes = numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    block = F.col("conv") - F.col("conv") % BLOCK
    firsts = sizes.where(F.col("conv") % BLOCK == 0).select(F.col("conv").alias("block"), F.col("n").alias("block_n"))
    shared = F.least(F.col("h"), F.coalesce("block_n", F.lit(0)))
    convs = written(
        sizes.withColumns({"block": block, "h": opening(F.col("conv"))}).join(firsts, "block", "left")
        .withColumn("shared", shared)
        .select("conv", "block", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")),
        "trie-conversations")
    own = numbered.where(F.col("k") > opening(F.col("conv"))).join(convs, "conv").select(
        "conv", "len", (F.col("k") - F.col("h") + F.col("shared")).alias("pos"), "i1", "i2", "points")
    heads = numbered.where((F.col("conv") % BLOCK == 0) & (F.col("k") < OPENING)).withColumnRenamed("conv", "block")
    taken = heads.join(convs, "block").where("k <= shared").select(
        "conv", "len", F.col("k").alias("pos"), "i1", "i2", "points")
    return convs.select("conv", "len"), written(own.union(taken), "trie-rebuilt")


# -- sweep of sorted containers -------------------------------------------------------------------

def sweep(sequences: list[tuple[list[tuple], int, int]], depth: int):
    """Nodes of a container whose sequences share their first turn.

    A sequence is (turns, conversation, weight), a turn (key, points) where equal keys mean equal
    prefixes.  Yields (conversation, depth, parent's conversation or None, members, children,
    leaves, saved, ending conversation or None, its weight) for each node; ``depth`` is that of
    the shared turn.
    """
    sequences = sorted(sequences, key=lambda s: [t[0] for t in s[0]])
    nodes: list[list] = []  # conversation, depth, parent, members, children, leaves, saved, ends, weight of ends, points
    path: list[int] = []

    def close(keep: int) -> None:
        while len(path) > keep:
            node = nodes[path.pop()]
            node[5] = node[5] or 1
            node[6] += (node[3] - 1) * node[9]
            if path:
                above = nodes[path[-1]]
                above[0] = min(above[0], node[0])
                above[3] += node[3]
                above[4] += 1
                above[5] += node[5]
                above[6] += node[6]

    before: list[tuple] = []
    for turns_, conversation, weight in sequences:
        common = 0
        while common < min(len(before), len(turns_)) and before[common][0] == turns_[common][0]:
            common += 1
        close(common)
        for i in range(common, len(turns_)):
            nodes.append([conversation, depth + i, path[-1] if path else None, 0, 0, 0, 0, None, 0, turns_[i][1]])
            path.append(len(nodes) - 1)
        end = nodes[path[-1]]
        end[0] = min(end[0], conversation)
        end[3] += weight
        end[7], end[8] = conversation, weight
        before = turns_
    close(0)
    for node in nodes:
        yield (*node[:2], None if node[2] is None else nodes[node[2]][0], *node[3:9])


_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, end_conv long, end_weight long, up1 long, up2 long")


def _swept(batches):
    """Rows sorted by container, sequence and position to nodes; the first node of a container
    carries the key of its parent (up1, up2), a trie head."""
    names = [x.split()[0] for x in _NODE.split(", ")]
    out: list[tuple] = []
    pending: list[tuple] = []
    container = None

    def finish() -> None:
        sequences, conversation = [], None
        for _, _, seq, _, weight, x1, x2, points, *_ in pending:
            if seq != conversation:
                sequences.append(([], seq, weight))
                conversation = seq
            sequences[-1][0].append(((x1, x2), points))
        depth, up = container[0], pending[0][8:10]
        out.extend((*node, *(up if node[1] == depth else (None, None))) for node in sweep(sequences, depth))

    def batch_of() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
        out.clear()
        return done

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (
            "c", "c1", "seq", "pos", "w", "x1", "x2", "points", "p1", "p2", "c2")]
        for row in zip(*columns):
            key = (row[0], row[1], row[10])
            if key != container:
                if pending:
                    finish()
                    pending.clear()
                    if len(out) >= 10_000:
                        yield batch_of()
                container = key
            pending.append(row)
    if pending:
        finish()
    if out:
        yield batch_of()


# -- hashes of the members that end at a node -----------------------------------------------------

def _joined(batches):
    """Rows (seq, conv) in order to blocks of comma-joined ids, ascending within the task."""
    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    seq, ids, size, block = None, [], 0, 0

    def cut() -> None:
        nonlocal ids, size, block
        if ids:
            rows.append((seq, part, block, ",".join(ids)))
        ids, size, block = [], 0, block + 1

    for batch in batches:
        for s, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != seq or size > JOINED:
                cut()
                seq = s
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(rows) > 1000 or sum(len(r[3]) for r in rows) > JOINED:
            yield _blocks_of(rows)
            rows = []
    cut()
    if rows:
        yield _blocks_of(rows)


def _blocks_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string()))],
        ["seq", "part", "block", "ids"])


def _hashed(batches):
    """Blocks in order to one digest per sequence; no more than a block is held."""
    seq, digest = None, None
    done: list[tuple] = []
    for batch in batches:
        for s, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
            if s != seq:
                if digest:
                    done.append((seq, digest.hexdigest()))
                seq, digest = s, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if digest:
        done.append((seq, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in done], pa.int64()), pa.array([d for _, d in done])], ["seq", "ends"])


def ends_of_copies(members: DataFrame) -> DataFrame:
    """(seq, ends): digest of the ascending conversations of each sequence, from (seq, conv).

    The conversations are sorted over range partitions and joined there; one task per sequence
    then hashes the blocks one after the other, as SHA-256 must, without holding them.
    """
    blocks = members.repartitionByRange("conv").sortWithinPartitions("seq", "conv").mapInArrow(
        _joined, "seq long, part int, block int, ids string")
    return blocks.repartition("seq").sortWithinPartitions("seq", "part", "block").mapInArrow(
        _hashed, "seq long, ends string")


# -- the trie -------------------------------------------------------------------------------------

def _burst(rows: DataFrame, limit: int, levels: int):
    """Heads below the root, children of heads, and the container of each sequence.

    heads, kids: depth, x1, x2, p1, p2 (the parent's key), seqs, n_convs, conv_id, points.
    containers: seq, c, c1, c2 (the key of the container's first node), seqs.
    """
    heads, kids, containers = [], [], []
    still, low = None, 0
    while True:
        level = rows.where((F.col("pos") > low) & (F.col("pos") <= low + levels))
        if still is not None:
            level = level.join(still, "seq", "left_semi")
        nodes = written(level.groupBy(F.col("pos").alias("depth"), "x1", "x2", "p1", "p2").agg(
            F.count(F.lit(1)).alias("seqs"), F.sum("w").alias("n_convs"), F.min("seq").alias("conv_id"),
            F.min("points").alias("points"), F.sum(F.col("len") - F.col("pos") + 1).alias("rows"),
        ).withColumn("big", (F.col("seqs") > 1) & (F.col("rows") > limit)), "trie-nodes")
        big = nodes.where("big")
        above = big.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"))
        heads.append(big)
        # Children of heads: those of this round's, and the first level, whose parents burst before.
        kids.append(nodes.where(F.col("depth") == low + 1).union(
            nodes.where(F.col("depth") > low + 1).join(above, ["depth", "p1", "p2"], "left_semi").select(*nodes.columns)))
        marked = level.select("seq", F.col("pos").alias("depth"), "len", "x1", "x2").join(
            nodes.select("depth", "x1", "x2", "seqs", "big"), ["depth", "x1", "x2"])
        at = F.min(F.when(~F.col("big"), F.struct("depth", "x1", "x2", "seqs")))
        settled = written(marked.groupBy("seq").agg(at.alias("at"), F.max("len").alias("len")), "trie-settled")
        containers.append(settled.where("at IS NOT NULL").select(
            "seq", F.col("at.depth").alias("c"), F.col("at.x1").alias("c1"), F.col("at.x2").alias("c2"), F.col("at.seqs").alias("seqs")))
        low, levels = low + levels, levels * 2
        still = settled.where((F.col("at").isNull()) & (F.col("len") > low)).select("seq")
        if still.isEmpty():
            return tuple(_union(x) for x in (heads, kids, containers))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _summed_down(heads: DataFrame) -> DataFrame:
    """Heads with ``n_leaves`` and ``saved_tokens`` of whole subtrees, from those of their own.

    After a round each head knows the sums of all heads less than twice as far below it, and its
    pointer leads twice as far up.
    """
    deepest = heads.agg(F.max("depth")).first()[0]
    reach = 1
    while reach <= deepest:
        below = heads.where("to_depth IS NOT NULL").groupBy(
            F.col("to_depth").alias("depth"), F.col("to1").alias("x1"), F.col("to2").alias("x2")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        further = heads.select(
            F.col("depth").alias("to_depth"), F.col("x1").alias("to1"), F.col("x2").alias("to2"),
            F.col("to_depth").alias("next_depth"), F.col("to1").alias("next1"), F.col("to2").alias("next2"))
        kept = [c for c in heads.columns if c not in ("n_leaves", "saved_tokens", "to_depth", "to1", "to2")]
        heads = written(
            heads.join(below, ["depth", "x1", "x2"], "left").join(further, ["to_depth", "to1", "to2"], "left").select(
                *kept, (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
                F.col("next_depth").alias("to_depth"), F.col("next1").alias("to1"), F.col("next2").alias("to2")),
            "trie-sums")
        reach *= 2
    return heads


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: ``COLUMNS``."""
    convs, plain = rebuilt(turns(conversations))
    own = [F.xxhash64(F.lit(s), "pos", "i1", "i2") for s in (3, 4)]
    rows = running(plain.select("conv", "len", "pos", "points", own[0].alias("o1"), own[1].alias("o2")),
                   "conv", ["pos"], "place", {"o1": "x1", "o2": "x2"}, {"points": "upto"}, "trie-rows")
    # Sequences: equal conversations have one, known by its smallest conversation.
    whole = rows.where("pos = len").select("conv", "len", "x1", "x2", "upto").union(
        convs.where("len = 0").select("conv", "len", *[F.lit(0).cast("long").alias(c) for c in ("x1", "x2", "upto")]))
    sequences = written(whole.groupBy("len", "x1", "x2").agg(
        F.min("conv").alias("seq"), F.count(F.lit(1)).alias("w"), F.min("upto").alias("total")), "trie-sequences")
    rows = written(
        rows.join(sequences.select(F.col("seq").alias("conv"), "w", "total"), "conv").select(
            F.col("conv").alias("seq"), "pos", "len", "x1", "x2", F.col("x1").bitwiseXOR(F.col("o1")).alias("p1"),
            F.col("x2").bitwiseXOR(F.col("o2")).alias("p2"), "points", "upto", "total", "w"), "trie-sequence-rows")
    heads, kids, containers = _burst(rows, limit, levels)

    # Below the heads: containers of one sequence are their rows, the others are swept.
    placed = rows.join(containers, "seq").where("pos >= c")
    top = F.col("pos") == F.col("c")
    single = placed.where("seqs = 1").select(
        F.col("seq").alias("conv_id"), F.col("pos").alias("depth"), F.when(~top, F.col("seq")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"), F.when(F.col("pos") < F.col("len"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("total") - F.col("upto") + F.col("points"))).alias("saved_tokens"),
        F.when(F.col("pos") == F.col("len"), F.col("seq")).alias("end_conv"),
        F.when(F.col("pos") == F.col("len"), F.col("w")).otherwise(0).alias("end_weight"),
        F.when(top, F.col("p1")).alias("up1"), F.when(top, F.col("p2")).alias("up2"))
    multiple = placed.where("seqs > 1").select("c", "c1", "c2", "seq", "pos", "w", "x1", "x2", "points", "p1", "p2").repartition(
        "c", "c1", "c2").sortWithinPartitions("c", "c1", "c2", "seq", "pos").mapInArrow(_swept, _NODE)
    below = written(single.union(multiple), "trie-below")

    # Heads, the root among them.
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    children = kids.groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    tops = below.where("up1 IS NOT NULL").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up1").alias("x1"), F.col("up2").alias("x2")).agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    zero = F.lit(0).cast("long")
    root = sequences.agg(F.min("seq").alias("conv_id"), F.sum("w").alias("n_convs")).where("conv_id IS NOT NULL").select(
        zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), F.lit(None).cast("long").alias("p1"),
        F.lit(None).cast("long").alias("p2"), "n_convs", "conv_id", zero.alias("points"))
    all_heads = root.union(heads.select("depth", "x1", "x2", "p1", "p2", "n_convs", "conv_id", "points"))
    ends = sequences.select(F.col("len").alias("depth"), "x1", "x2", F.col("seq").alias("end_conv"), F.col("w").alias("end_weight"))
    key = ["depth", "x1", "x2"]
    counted = written(
        all_heads.join(children, key, "left").join(tops, key, "left").join(ends, key, "left").select(
            *key, "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "end_conv",
            F.coalesce("end_weight", zero).alias("end_weight"), "p1", "p2",
            F.when(F.col("n_children").isNull(), 1).otherwise(F.coalesce("leaves", zero)).cast("long").alias("n_leaves"),
            (F.coalesce("saved", zero) + (F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"),
            F.when(F.col("depth") > 0, F.col("depth") - 1).alias("to_depth"), F.col("p1").alias("to1"), F.col("p2").alias("to2")),
        "trie-heads")
    summed = _summed_down(counted) if not counted.isEmpty() else counted

    parent = summed.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("up1"), F.col("x2").alias("up2"),
                           F.col("conv_id").alias("above"))
    measures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "end_conv", "end_weight"]
    tops = below.where("up1 IS NOT NULL").join(parent, ["depth", "up1", "up2"]).select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), *measures)
    over = summed.withColumnsRenamed({"p1": "up1", "p2": "up2"}).join(parent, ["depth", "up1", "up2"], "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), *measures)
    nodes = below.where("up1 IS NULL").select("conv_id", "depth", "parent_conv_id", *measures).union(tops).union(over)

    # Where one conversation ends, its digest needs no gathering.
    members = whole.join(sequences.where("w > 1").select("len", "x1", "x2", "seq"), ["len", "x1", "x2"]).select("seq", "conv")
    copies = written(ends_of_copies(members), "trie-ends").withColumnRenamed("seq", "end_conv")
    alone = nodes.where("end_weight <= 1").withColumn(
        "ends_sha256", F.sha2(F.coalesce(F.col("end_conv").cast("string"), F.lit("")).cast("binary"), 256))
    several = nodes.where("end_weight > 1").join(copies, "end_conv").withColumnRenamed("ends", "ends_sha256")
    return alone.select(*COLUMNS).union(several.select(*COLUMNS))


def op13_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = {"op13_burst_trie": """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS digits, 0 AS step, 4294967295::BIGINT AS v FROM turns
  UNION ALL
  SELECT conv_id, digits, step + 1, CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384::BIGINT) ELSE u >> 1 END
  FROM (SELECT conv_id, digits, step,
               CASE WHEN step % 8 = 0 THEN xor(v, ascii(substr(digits, step // 8 + 1, 1))::BIGINT) ELSE v END AS u
        FROM crc WHERE step < 8 * length(digits))),
convs AS (SELECT conv_id, xor(v, 4294967295::BIGINT) % 6 AS h FROM crc WHERE step = 8 * length(digits)),
parts AS (
  SELECT c.conv_id, 0 AS part, t.k, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.k < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k >= c.h),
paths AS (
  SELECT conv_id, length(text) AS points, row_number() OVER w AS depth,
         md5(string_agg(md5(length(role) || ':' || role || text), ',') OVER w) AS node
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)),
members AS (
  SELECT conv_id, depth, points, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS above
  FROM paths
  UNION ALL
  SELECT conv_id, 0, 0, 'root', NULL FROM convs),
nodes AS (
  SELECT node, min(depth) AS depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(points) AS points
  FROM members GROUP BY node),
children AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
under AS (SELECT DISTINCT a.node, b.node AS lower FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT u.node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.points) AS saved_tokens
  FROM under u JOIN nodes n ON n.node = u.lower LEFT JOIN children c ON c.node = u.lower GROUP BY u.node),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, node, depth, max(depth) OVER (PARTITION BY conv_id) AS last FROM members) WHERE depth = last
  GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs,
       coalesce(c.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN nodes p ON p.node = n.above
LEFT JOIN children c ON c.node = n.node LEFT JOIN ends e ON e.node = n.node"""}

QUERIES = {"op13_burst_trie": op13_burst_trie}
