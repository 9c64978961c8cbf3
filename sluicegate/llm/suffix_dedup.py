"""Repeated passages by longest-previous-factor arrays.

A text start is repeated if its suffix shares a prefix of ``length`` bytes with another suffix of
the corpus.  In suffix order the best match that starts earlier in the corpus is the previous or
the next suffix of smaller position, so the longest previous factor (LPF) of a start is the larger
of two common prefixes; the longest next factor is the same with larger positions.

The suffixes are dealt out so that equal prefixes meet.  Among the ``gram``-byte strings inside a
window of ``length`` bytes the one of the least hash is the window's anchor (the first, if it
recurs).  Equal windows have equal anchors, and an anchor serves a run of windows.  Anchors are
counted; one that occurs once serves no repeated window.  Members of an anchor's group whose
windows all agree, text and all, form a class, and a class of two or more is repeated as a whole.
Only groups that hold a class of one need their text: one member of each class is fetched, the
group's suffixes are put in order in one task, and their LPF arrays tell which windows recur.  A
group of more than ``HOT_CLASSES`` classes is not collected; there the windows themselves are
grouped by hash, with partial aggregation.  Nothing is capped or left out in either way.

Matches never cross documents.  A null text counts as empty; texts shorter than ``length`` have
no repeated string.  Rows that repeat a doc_id are documents of their own, except that rows
equal in doc_id and text are in the same place in the order of the corpus (by doc_id, then a
hash of the text; null first).  An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.base import id_key, mix, prefix_hashes, slices, table, values, written
from sluicegate.session import shuffle_partitions

LENGTH, GRAM = 400, 136
#: Bytes hashed at a time.
BATCH_BYTES = 1_000_000
#: Classes that are put into suffix order together, and windows of a batch of such groups.
HOT_CLASSES, BATCH_WINDOWS = 1000, 60_000
_PLACE = np.uint64((1 << 24) - 1)


def anchors(texts: list[bytes], length: int, gram: int):
    """Runs of windows by anchor: text, first and last window, anchor place, the anchor's hash, and
    a hash of the whole run (its text and how its windows lie around the anchor)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums, inverse = prefix_hashes(data)
    hashes = mix((sums[gram:] - sums[:-gram]) * inverse[:len(data) - gram + 1])
    # Least hash of each window, ties to the first place: the place is in the low bits.
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    wide, span = length - gram + 1, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[:span - wide], least[wide - span:])
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)[:len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= end[owner])
    place, owner = (least[start] & _PLACE).astype(np.int64), owner[start]
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    low, high = start[first], start[np.append(first[1:], len(start)) - 1]
    place, owner = place[first], owner[first]
    whole = mix((sums[high + length] - sums[low]) * inverse[low])
    shape = ((place - low).astype(np.uint64) << np.uint64(32)) | (high - low).astype(np.uint64)
    begin = (end - size)[owner]
    return owner, low - begin, high - begin, place - begin, hashes[place], mix(whole ^ mix(shape + np.uint64(1)))


def _anchored(length: int, gram: int):
    def run(batches):
        for batch in batches:
            texts = values(batch.column("text"))
            rows, ids = batch.column("row").to_numpy(), batch.column("doc_id")
            for a, b in _long_alone(texts, BATCH_BYTES):
                for part, base in _pieces(texts[a:b], length):
                    owner, low, high, place, g, whole = anchors(part, length, gram)
                    if not len(owner):
                        continue
                    at = (low + base) << 24 | (high - low) << 12 | (place - low)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(rows[a + owner]),
                         ids.take(pa.array(a + owner)), pa.array(at)], ["anchor", "whole", "row", "doc_id", "at"])

    return run


def _long_alone(texts: list[bytes], most: int):
    """Slices in which a text of more than ``most`` bytes has no others beside it, empty ones neither."""
    for a, b in slices(texts, most):
        for i in range(a, b):
            if len(texts[i]) > most:
                if a < i:
                    yield a, i
                yield i, i + 1
                a = i + 1
        if a < b:
            yield a, b


def _pieces(texts: list[bytes], length: int, most: int = BATCH_BYTES):
    """A very long text in pieces that share ``length - 1`` bytes, so that each window is in one."""
    if len(texts) == 1 and len(texts[0]) > most:
        for base in range(0, len(texts[0]) - length + 1, most):
            yield [texts[0][base:base + most + length - 1]], base
    else:
        yield texts, 0


def longest_factors(windows: np.ndarray, position: np.ndarray):
    """(LPF, LNF) of suffixes, given their first bytes (a row each) and their places in the corpus.

    Common prefixes are measured up to the width of the rows.
    """
    n, width = windows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A last byte of 1 keeps numpy from dropping zeros at the end of a string.
    keys = np.concatenate([windows, np.ones((n, 1), np.uint8)], axis=1).view(f"S{width + 1}").ravel()
    order = np.lexsort((position, keys))
    ordered, place = windows[order], position[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    out = []
    for sign in (1, -1):
        best = np.zeros(n, np.int64)
        for step in (1, -1):  # nearest suffix before, then after, with a smaller place
            p, lcp = (sign * place)[::step], common[::step]
            best = np.maximum(best, _to_smaller(p, lcp)[::step])
        result = np.empty(n, np.int64)
        result[order] = best
        out.append(result)
    return out[0], out[1]


def _to_smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix with the nearest earlier element of smaller place (0 if there is none)."""
    n = len(place)
    to = np.arange(n) - 1
    shared = np.concatenate([[0], common])
    while True:
        move = np.flatnonzero((to >= 0) & (place[np.maximum(to, 0)] > place))
        if not len(move):
            return np.where(to >= 0, shared, 0)
        # All elements between an element and its pointer are larger, also after a jump.
        shared[move] = np.minimum(shared[move], shared[to[move]])
        to[move] = to[to[move]]


def _window_hashes(bodies: list[bytes], length: int):
    """Hash of each window of each body: hashes, body, start in the body."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sums, inverse = prefix_hashes(data)
    size = np.array([len(b) for b in bodies], np.int64)
    many = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(bodies)), many)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at = (np.cumsum(size) - size)[owner] + inside
    return mix((sums[at + length] - sums[at]) * inverse[at]), owner, inside, at, data


def _recurring(bodies: list[bytes], position: np.ndarray, length: int):
    """Windows with another of the same text: body, start in the body, whether one is earlier."""
    hashes, owner, inside, at, data = _window_hashes(bodies, length)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    # Suffixes whose first bytes hash like no other have no factor of that length.
    some = np.flatnonzero(twice)
    if not len(some):
        return owner[:0], inside[:0], twice[:0]
    windows = data[at[some][:, None] + np.arange(length)]
    previous, following = longest_factors(windows, (position[owner[some]] << 20) + inside[some])
    found = (previous >= length) | (following >= length)
    return owner[some][found], inside[some][found], (previous >= length)[found]


def _runs(start: np.ndarray) -> list[tuple[int, int]]:
    """Sorted numbers as (first, last) of consecutive ones."""
    if not len(start):
        return []
    cut = np.flatnonzero(np.diff(start) != 1)
    return list(zip(start[np.append(0, cut + 1)].tolist(), start[np.append(cut, len(start) - 1)].tolist()))


_FOUND = "anchor long, whole long, first int, last int, earlier boolean"


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "whole", "first", "last", "earlier"])


def _suffix_ordered(length: int):
    """Rows come sorted by anchor; groups are put into suffix order a batch at a time."""

    def solve(group: dict) -> list[tuple]:
        # Places of the classes in the corpus, by their first members.
        keys = list(group)
        place = sorted(range(len(keys)), key=lambda i: group[keys[i]][1])
        position = np.empty(len(keys), np.int64)
        position[place] = np.arange(len(keys))
        owner, inside, earlier = _recurring([group[k][0] for k in keys], position, length)
        rows = []
        for i in np.unique(owner):
            mine = owner == i if len(keys) < 50 else slice(*np.searchsorted(owner, [i, i + 1]))
            for only_earlier in (False, True):
                start = np.sort(inside[mine][earlier[mine]] if only_earlier else inside[mine])
                rows += [(*keys[i], a, b, only_earlier) for a, b in _runs(start)]
        return rows

    def run(batches):
        pending, windows, current = {}, 0, None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("anchor", "whole", "row", "at", "body")]
            for anchor, whole, row, at, body, doc in zip(*columns, ids):
                if anchor != current and windows > BATCH_WINDOWS:
                    yield _found_batch(solve(pending))
                    pending, windows = {}, 0
                current = anchor
                if (anchor, whole) not in pending:
                    pending[anchor, whole] = (body, ((doc is not None, doc if doc is not None else 0), row, at))
                    windows += len(body) - length + 1
        if pending:
            yield _found_batch(solve(pending))

    return run


def _bodies(length: int):
    """The text of each wanted run of windows."""

    def run(batches):
        for batch in batches:
            out = []
            for text, row, doc, wanted in zip(values(batch.column("text")), batch.column("row").to_pylist(),
                                              batch.column("doc_id").to_pylist(), batch.column("wanted").to_pylist()):
                for w in wanted:
                    low, more = w["at"] >> 24, (w["at"] >> 12) & 4095
                    out.append((w["anchor"], w["whole"], row, doc, w["at"], w["hot"], text[low:low + more + length]))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "whole", "row", "doc_id", "at", "hot", "body"])

    return run


def _hashed_windows(length: int):
    def run(batches):
        for batch in batches:
            bodies = values(batch.column("body"))
            for a, b in slices(bodies, BATCH_BYTES):
                hashes, owner, inside, *_ = _window_hashes(bodies[a:b], length)
                who = pa.array(a + owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), *(batch.column(c).take(who) for c in ("anchor", "whole", "doc_id", "row", "at")),
                     pa.array(inside.astype(np.int32))], ["window", "anchor", "whole", "doc_id", "row", "at", "start"])

    return run


def _joined(batches):
    for batch in batches:
        rows = []
        for anchor, whole, *starts in zip(*(batch.column(c).to_pylist() for c in ("anchor", "whole", "starts", "later"))):
            for earlier, some in enumerate(starts):
                rows += [(anchor, whole, a, b, bool(earlier)) for a, b in _runs(np.sort(np.array(some, np.int64)))]
        yield _found_batch(rows)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """(row, start, end): bytes of documents covered by a string of ``length`` bytes that starts
    elsewhere too; with ``keep_first``, elsewhere earlier.  ``row`` is ``row_key`` of the document."""
    if not 0 <= length - gram <= 4095:
        raise ValueError("length - gram must be from 0 to 4095")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = keyed_texts(docs)
    every = written(keyed.mapInArrow(
        _anchored(length, gram), f"anchor long, whole long, row long, doc_id {id_type}, at long"), "suffix-anchors")
    # Counts are written, so that the join reads both sides as they are and can split a hot anchor.
    counted = written(every.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")).where("n > 1").drop("n"), "suffix-counts")
    members = written(every.join(counted, "anchor"), "suffix-members")
    place = F.struct("doc_id", "row", "at")
    classes = written(members.groupBy("anchor", "whole", "mixed").agg(
        F.count(F.lit(1)).alias("copies"), F.min(place).alias("first_place")), "suffix-classes")
    # Groups that hold a class of one are put into suffix order.
    open_ = (
        classes.where("mixed").groupBy("anchor").agg(F.min("copies").alias("least"), F.count(F.lit(1)).alias("classes"))
        .where(F.lit(keep_first) | (F.col("least") == 1)).select("anchor", (F.col("classes") > HOT_CLASSES).alias("hot")))
    wanted = (
        classes.where("mixed").join(open_, "anchor")
        .select(F.col("first_place.row").alias("row"), F.struct(
            "anchor", "whole", F.col("first_place.at").alias("at"), "hot").alias("w"))
        .groupBy("row").agg(F.collect_list("w").alias("wanted")))  # at most the anchors of one text
    bodies = written(
        keyed.join(wanted, "row").select("row", "doc_id", "text", "wanted")
        .mapInArrow(_bodies(length), f"anchor long, whole long, row long, doc_id {id_type}, at long, hot boolean, body binary"),
        "suffix-bodies")
    ordered = (
        bodies.where("NOT hot").select("anchor", "whole", "row", "doc_id", "at", "body")
        .repartition(max(1, shuffle_partitions(docs.sparkSession)), "anchor").sortWithinPartitions("anchor")
        .mapInArrow(_suffix_ordered(length), _FOUND))
    windows = bodies.where("hot").dropDuplicates(["anchor", "whole"]).mapInArrow(
        _hashed_windows(length), f"window long, anchor long, whole long, doc_id {id_type}, row long, at long, start int")
    least = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "at", "start")).alias("least"))
    first = F.struct("doc_id", "row", "at", "start") == F.col("least")
    hot = (
        windows.join(least.where("n > 1"), "window").groupBy("anchor", "whole")
        .agg(F.collect_set("start").alias("starts"), F.collect_set(F.when(~first, F.col("start"))).alias("later"))
        .mapInArrow(_joined, _FOUND))
    found = ordered.unionByName(hot).where(F.col("earlier") == F.lit(keep_first)).drop("earlier")

    low, more = F.shiftright("at", 24), F.shiftright("at", 12).bitwiseAND(F.lit(4095))
    copied = classes.where("copies > 1").select("anchor", "whole", "first_place")
    whole = members.select("anchor", "whole", "row", "doc_id", "at").join(copied, ["anchor", "whole"])
    if keep_first:  # the first member of a class has no earlier copy in it
        whole = whole.where(place != F.col("first_place"))
        rest = classes
    else:
        rest = classes.where("copies = 1")
    part = rest.join(found, ["anchor", "whole"]).select(
        F.col("first_place.row").alias("row"),
        (F.shiftright("first_place.at", 24) + F.col("first")).alias("start"),
        (F.shiftright("first_place.at", 24) + F.col("last") + length).alias("end"))
    return whole.select("row", low.alias("start"), (low + more + length).alias("end")).unionByName(part)


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select(
        F.xxhash64(id_key(F.col("doc_id")), "text").alias("row"), "doc_id", "text")


def _without(full_text: bool):
    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, spans in zip(values(batch.column("text")), batch.column("spans").to_pylist()):
                kept, upto, removed, runs = [], 0, 0, 0
                last = -1
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    begin = max(s[0], upto)
                    runs += s[0] > last
                    last = max(last, s[1])
                    if s[1] > upto:
                        kept.append(text[upto:begin])
                        removed += s[1] - begin
                        upto = s[1]
                kept.append(text[upto:])
                body = b"".join(kept)
                out[0].append(len(text))
                out[1].append(removed)
                out[2].append(runs)
                out[3].append(body.decode("utf-8", "replace") if full_text else hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True,
                    digests: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans and ``kept``, the remaining text
    (bytes cut inside a character are replaced) or its SHA-256."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, length, gram, keep_first)
    # A text has fewer spans than bytes.
    per_row = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return keyed_texts(docs).join(per_row, "row", "left").select("doc_id", "text", "spans").mapInArrow(
        _without(not digests), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept string")


def op3_lpf_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a repeated passage is removed, the first one too."""
    return without_repeats(table(spark, sf_dir, "documents"), keep_first=False, digests=True).withColumnRenamed(
        "kept", "kept_sha256")


QUERIES = {"op3_lpf_repeats": op3_lpf_repeats}
#: Windows are compared by hash, bytes are written in hexadecimal.
SQL = {"op3_lpf_repeats": r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS body, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
starts AS (SELECT doc_id, body, unnest(range(1, n_bytes - 398)) AS i FROM bytes),
windows AS (SELECT doc_id, i, hash(substr(body, 2 * i - 1, 800)) AS h FROM starts),
repeated AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM repeated),
grouped AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS first, max(i) + 400 AS behind FROM grouped GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, span, coalesce(lag(behind) OVER (PARTITION BY doc_id ORDER BY span), 1) AS open, first, behind FROM spans),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(behind - first)::BIGINT AS n_removed,
         string_agg(substr(body, 2 * open - 1, 2 * (first - open)), '' ORDER BY span) || substr(any_value(body), 2 * max(behind) - 1) AS body
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, b.n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.body, b.body))) AS kept_sha256
FROM bytes AS b LEFT JOIN kept AS k USING (doc_id)"""}
