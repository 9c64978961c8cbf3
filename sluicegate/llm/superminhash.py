"""Near copies by SuperMinHash, banding, verification and union-find.

Signature.  Every shingle of a document walks through the places of the signature in a random
order of its own; at step j it offers ``j + random`` to its j-th place, and each place keeps the
least offer.  The ranks of one shingle are correlated (no place is visited twice), which lowers
the variance of the estimate.  Steps are taken for all shingles at once; a document stops
early as soon as each place holds an offer of an earlier step, since later ones are larger.

Candidates.  Documents with equal shingle sets are one class and go on as one.  Bands of the
signature form buckets.  First each bucket has one pivot, its member in most other buckets, that
is compared with the others; a bucket of thousands of copies takes one comparison per member.
Then only buckets whose members are still in different components are open.  Two members of open
buckets either share a rare shingle (in at most ``RARE`` of these documents), and such pairs are
listed by shingle; or their common shingles are not rare, which bounds their similarity by their
numbers of shingles that are not rare.  Few members can pass that bound, and only pairs that pass
are listed.  So no linked pair is lost, and no bucket is written out in pairs.

Verification.  A pair must pass a bound from its sizes and a sketch (the low byte of each
signature place, far below the threshold: a true link fails it with a chance below 1e-9);
then both full sets are compared exactly.  With 42 bands of 6 places a pair at 0.85 shares no
band with a chance of 6e-9.

Null and empty texts and texts of white space have no shingles and are linked with nothing; with
fewer than ``k`` words the whole sequence is the one shingle.  Rows that repeat a doc_id are read
as rows of one document, which has the shingles of its largest row.  A null doc_id takes no part
in links and is its own component (null).  An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.base import mix, releasing, restricted, slices, table, values, word_hashes, written
from sluicegate.llm.components import components

BANDS, ROWS = 42, 6
#: Bytes of text shingled at a time.
BATCH_BYTES = 1_000_000
#: Share of equal sketch bytes below which a pair at the threshold cannot be, and the same
#: relative to other thresholds: threshold - 0.15.
SKETCH_MARGIN = 0.15
#: Documents that hold a shingle, at most, for pairs to be listed by it.
RARE = 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW32 = np.uint64(0xFFFFFFFF)
_FACTORS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts after each other, and how many each has."""
    words, count = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), count)
    end = np.cumsum(count)
    # Shingles start at each word but the last k - 1; a shorter text has one, at its first word.
    left = end[owner] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    starts = np.flatnonzero((left >= k) | (left == count[owner]))
    h = words[starts].copy()
    for j in range(1, k):
        inside = left[starts] > j
        nxt = np.where(inside, words[np.minimum(starts + j, len(words) - 1)], np.uint64(j))
        h = mix(h * _FACTORS[0] + mix(nxt * _FACTORS[1]))
    who = owner[starts]
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(who[order], kind="stable")]
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return h[new], np.bincount(who[new], minlength=len(texts))


def signatures(hashes: np.ndarray, count: np.ndarray, places: int) -> np.ndarray:
    """SuperMinHash signatures, a row per set; an empty set keeps the largest number."""
    n = len(count)
    owner = np.repeat(np.arange(n), count)
    best = np.full(n * places, np.iinfo(np.uint64).max, np.uint64)
    live, history = np.arange(len(hashes)), []
    for j in range(places):
        if not len(live):
            break
        u = mix(hashes[live] + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
        at = j + (((u & _LOW32) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        place = at
        for t in range(j - 1, -1, -1):  # undo the swaps of the shuffle
            place = np.where(place == history[t], t, place)
        offer = (np.uint64(j) << np.uint64(32)) | (u >> np.uint64(32))
        np.minimum.at(best, owner[live] * places + place, offer)
        history.append(at)
        # Early stop: all places of a document are filled.
        full = best.reshape(n, places).max(axis=1) < (np.uint64(j + 1) << np.uint64(32))
        stay = ~full[owner[live]]
        live = live[stay]
        history = [x[stay] for x in history]
    return best.reshape(n, places)


def _signed(k: int, bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            texts = values(batch.column("text"))
            size, digest, keys, sketch = [], [], [], []
            for a, b in slices(texts, BATCH_BYTES):
                hashes, count = shingle_sets(texts[a:b], k)
                s = signatures(hashes, count, bands * rows)
                key = np.zeros((len(count), bands), np.uint64)
                for j in range(rows):
                    key = mix(key * _FACTORS[0] + s[:, j::rows] + np.uint64(j))
                key += np.arange(bands, dtype=np.uint64) * _STEP
                end = np.cumsum(count)
                size += count.tolist()
                digest += [hashlib.blake2b(hashes[e - c:e].tobytes(), digest_size=16).digest() for e, c in zip(end, count)]
                keys += list(mix(key).view(np.int64))
                sketch += [x.tobytes() for x in (s & np.uint64(255)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return releasing(sign)


def _sets(k: int):
    def shingled(batches):
        for batch in batches:
            texts = values(batch.column("text"))
            out = []
            for a, b in slices(texts, BATCH_BYTES):
                hashes, count = shingle_sets(texts[a:b], k)
                end = np.cumsum(count)
                out += [hashes[e - c:e].tobytes() for e, c in zip(end, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "hashes"])

    return releasing(shingled)


def _alike_sketches(least: float):
    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for c in ("sketch_a", "sketch_b"))
            ok = (x == y).mean(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return keep


def _linked(percent: int):
    def verify(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return verify


def _shingles_of(batches):
    for batch in batches:
        sets = values(batch.column("hashes"))
        size = np.array([len(x) // 8 for x in sets])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.frombuffer(b"".join(sets), np.int64)),
             batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sets)), size)))], ["shingle", "a"])


class _Search:
    """Candidate pairs (a, b) and their verification; every table is written once."""

    def __init__(self, texts: DataFrame, signed: DataFrame, k: int, percent: int, bands: int):
        self.percent, self.texts, self.k = percent, texts, k
        self.id_type = texts.schema["doc_id"].dataType.simpleString()
        shingled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        # Equal sets are one class, known by its smallest document.
        self.classes = written(shingled.groupBy("digest").agg(F.min("doc_id").alias("a")), "near-classes")
        reps = written(
            shingled.select(F.col("doc_id").alias("a"), "digest", F.col("n_shingles").alias("n"), "bands", "sketch")
            .join(self.classes, ["digest", "a"]).dropDuplicates(["digest", "a"]).drop("digest"), "near-representatives")
        every = reps.select("a", "n", F.posexplode("bands").alias("place", "band"))
        shared = every.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        self.members = written(every.join(shared, "band"), "near-buckets")
        hubs = written(self.members.groupBy("a").agg(F.sum("size").alias("hub")), "near-hubs")
        self.hubs = hubs
        self.reps = written(reps.join(hubs, "a"), "near-members")
        self.sets = written(
            restricted(texts, hubs.select(F.col("a").alias("doc_id")))
            .mapInArrow(_sets(k), f"doc_id {self.id_type}, hashes binary")
            .groupBy("doc_id").agg(F.max_by("hashes", F.length("hashes")).alias("hashes")), "near-sets")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sets are similar enough."""
        p = self.percent
        one = self.reps.select("a", "n", F.col("sketch").alias("sketch_a"))
        two = self.reps.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("sketch_b"))
        kinds = f"a {self.id_type}, b {self.id_type}"
        likely = written(
            pairs.distinct().join(one, "a").join(two, "b").where(f"100 * least(n, m) >= {p} * greatest(n, m)")
            .select("a", "b", "sketch_a", "sketch_b").mapInArrow(_alike_sketches(p / 100 - SKETCH_MARGIN), kinds), "near-likely")
        return written(
            likely.join(self.sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("set_a")), "a")
            .join(self.sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("set_b")), "b")
            .select("a", "b", "set_a", "set_b").mapInArrow(_linked(p), kinds), "near-links")

    def by_pivots(self) -> DataFrame:
        """Each bucket's pivot beside its other members."""
        placed = self.members.select("band", "a").join(self.hubs, "a")
        pivots = placed.groupBy("band").agg(F.max(F.struct("hub", "a")).getField("a").alias("pivot"))
        return placed.join(pivots, "band").where("a <> pivot").select(
            F.least("a", "pivot").alias("a"), F.greatest("a", "pivot").alias("b"))

    def across(self, links: DataFrame) -> DataFrame:
        """Pairs in open buckets that may be linked although the pivots did not link them."""
        p = self.percent
        state = written(
            self.members.where("size > 2").join(components(links).withColumnRenamed("node", "a"), "a", "left")
            .withColumn("component", F.coalesce("component", "a")), "near-state")
        open_ = (
            state.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least_n"))
            .where("low <> high").select("band", "least_n"))
        live = written(state.join(open_, "band"), "near-open")
        docs = live.select("a", "component").distinct()
        postings = written(
            restricted(self.sets, docs.select(F.col("a").alias("doc_id"))).select("doc_id", "hashes")
            .mapInArrow(_shingles_of, f"shingle long, a {self.id_type}"), "near-shingles")
        rare = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") <= RARE)
        rare = written(postings.join(rare, "shingle"), "near-rare")
        shared = rare.where("held > 1").join(docs, "a").select("shingle", "a", "component")
        other = shared.select("shingle", F.col("a").alias("b"), F.col("component").alias("other"))
        listed = shared.join(other, "shingle").where("a < b AND component <> other").select("a", "b")

        common = rare.groupBy("a").agg(F.count(F.lit(1)).alias("rare"))
        alive = (
            live.join(common, "a", "left").withColumn("common", F.col("n") - F.coalesce("rare", F.lit(0)))
            .where(f"common * (100 + {p}) >= {p} * (n + least_n)")
            .join(self.reps.select("a", "bands"), "a").select("band", "place", "a", "n", "common", "component", "bands"))
        alive = written(alive, "near-alive")
        pair = [F.col(c).alias(f"{c}_b") for c in ("a", "n", "common", "component", "bands")]
        # A pair is listed in the first band that it shares.
        first = F.array_position(F.zip_with("bands", "bands_b", lambda x, y: x == y), True) - 1
        bounded = alive.join(alive.select("band", *pair), "band").where(
            (F.col("a") < F.col("a_b")) & (F.col("component") != F.col("component_b"))
            & F.expr(f"least(common, common_b) * (100 + {p}) >= {p} * (n + n_b)") & (first == F.col("place")))
        return listed.union(bounded.select("a", F.col("a_b").alias("b")))


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents whose sets of k-word shingles have a Jaccard similarity of ``percent`` or more are
    linked; a component is called by its smallest doc_id, which is kept.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    signed = written(texts.mapInArrow(
        _signed(k, bands, rows),
        f"doc_id {id_type}, n_shingles long, digest binary, bands array<long>, sketch binary"), "near-signatures")
    search = _Search(texts, signed, k, percent, bands)
    links = search.linked(search.by_pivots())
    links = written(links.union(search.linked(search.across(links))), "near-links")
    classed = (
        search.classes.join(components(links).withColumnRenamed("node", "a"), "a", "left")
        .select("digest", F.coalesce("component", "a").alias("component")))
    member = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = F.when(member, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "digest").join(classed, "digest", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"),
                F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept")))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with its columns."""
    return restricted(docs, near_copies(docs, **options).where("kept"))


def op6_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES = {"op6_superminhash_near_dedup": op6_superminhash_near_dedup}
SQL = {"op6_superminhash_near_dedup": r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END) AS shingle
  FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles AS a JOIN shingles AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reached.doc_id, b FROM reached JOIN both_ways ON other = a),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents AS d JOIN components USING (doc_id) LEFT JOIN sizes USING (doc_id)"""}
