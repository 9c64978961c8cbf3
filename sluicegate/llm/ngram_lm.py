"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

The model is counted in Spark and never gathered in one place.  Word pairs are dealt out by the
first word; pairs of a frequent first word are spread over several buckets.  A bucket merges its
pairs into sorted hash arrays.  What a bucket must know about words in general (how often they
occur, after how many different words, totals of a spread first word) it asks from buckets of
words and gets back in the order asked.  It then puts its part of the model, sorted hashes with
log probabilities, into a file that is memory-mapped while the pairs of all blocks of documents
are looked up in it, and returns partial sums per document.

Texts are read whole in blocks; only training documents are counted, all documents are scored.
Words are known by 64-bit hashes.  Modified Kneser-Ney: three discounts per order, from counts of
counts; the lower order counts different predecessors and is interpolated with the uniform
distribution over the known words and one unknown word.

A null text counts as empty: its one token is the end.  Rows that repeat a doc_id are documents of
their own; a null doc_id counts as the empty text where documents are split.  An empty table gives
no rows, and without training documents every probability is one.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.base import crc_mod, mix, pack, pack_sorted, slices, table, unpack, unpack_sorted, values, word_hashes, written
from sluicegate.session import shuffle_partitions

#: Bytes of text in a block, and hashed at a time; tokens in a bucket of pairs, about.
BLOCK_BYTES, HASH_BYTES, BUCKET_TOKENS = 10_000_000, 1_000_000, 2_500_000
#: A first word that fills more than this part of a bucket is spread.
HOT_PART = 0.25
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_FACTORS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _FACTORS[0] + mix(second * _FACTORS[1]))


def token_pairs(texts: list[bytes]):
    """Tokens with their predecessors, and the tokens of each text: (first, second, counts)."""
    found = [word_hashes(texts[a:b]) for a, b in slices(texts, HASH_BYTES)]
    words = np.concatenate([np.zeros(0, np.uint64), *(f[0] for f in found)])
    count = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)]).astype(np.int64) + 1
    stop = np.cumsum(count)
    second = np.empty(int(stop[-1]) if len(stop) else 0, np.uint64)
    last = np.zeros(len(second), bool)
    last[stop - 1] = True
    second[last], second[~last] = END, words
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[stop - count] = START
    return first, second, count


def _summed(keys: np.ndarray, *amounts: np.ndarray):
    """Distinct keys in order, with summed amounts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(a[order], first) if len(first) else a for a in amounts)


def _blocks(batches):
    """(block number, ids, texts, training flags) of documents in their order."""
    for batch in batches:
        texts, train = values(batch.column("text")), batch.column("train").to_numpy(zero_copy_only=False)
        for a, b in slices(texts, BLOCK_BYTES):
            # The number of a block is made from what it holds.
            rows = batch.column("row").slice(a, b - a).to_numpy()
            number = int.from_bytes(hashlib.blake2b(rows.tobytes(), digest_size=8).digest(), "little", signed=True)
            yield number, batch.column("doc_id").slice(a, b - a), texts[a:b], train[a:b]


def _binary(rows: list[tuple], names: list[str], longs: int) -> pa.RecordBatch:
    kinds = [pa.int64()] * longs + [pa.binary()] * (len(names) - longs)
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _cuts(buckets: np.ndarray):
    """(bucket, begin, end) of a sorted array."""
    if len(buckets):
        at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        yield from zip(buckets[at].tolist(), at.tolist(), np.append(at[1:], len(buckets)).tolist())


def _word_buckets(words: np.ndarray, many: int) -> np.ndarray:
    return ((words >> np.uint64(20)) % np.uint64(many)).astype(np.int64)


def _word_counts(many: int):
    def run(batches):
        for _, _, texts, train in _blocks(batches):
            _, words, _ = token_pairs([t for t, use in zip(texts, train) if use])
            words, counts = _summed(words, np.ones(len(words), np.int64))
            bucket = _word_buckets(words, many)
            order = np.argsort(bucket, kind="stable")
            words, counts, bucket = words[order], counts[order], bucket[order]
            yield _binary([(b, pack_sorted(words[x:y]), pack(counts[x:y])) for b, x, y in _cuts(bucket)],
                          ["bucket", "words", "counts"], 1)

    return run


def _merged_words(pdf: pd.DataFrame) -> pd.DataFrame:
    words, counts = _summed(
        np.concatenate([unpack_sorted(x) for x in pdf["words"]]), np.concatenate([unpack(x, np.int64) for x in pdf["counts"]]))
    # The largest counts of a bucket: more than enough to find all hot words.
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "words": [pack_sorted(words)], "counts": [pack(counts)],
                         "tokens": [int(counts.sum())], "types": [len(words)]})


def _hot_words(least: float):
    def run(batches):
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                words, counts = unpack_sorted(words), unpack(counts, np.int64)
                hot = counts > least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[hot].view(np.int64)), pa.array(counts[hot])], ["word", "n"])

    return run


class Dealing:
    """To which bucket a pair goes."""

    def __init__(self, labels: list[int], hot: dict[int, int]):
        self.labels, self.buckets = labels, len(labels)
        self.words = np.array(sorted(hot), np.uint64)
        self.spread = np.array([hot[w] for w in sorted(hot)], np.uint64)

    def is_hot(self, first: np.ndarray):
        """Whether each first word is spread, and over how many buckets."""
        if not len(self.words):
            return np.zeros(len(first), bool), np.ones(len(first), np.uint64)
        at = np.minimum(np.searchsorted(self.words, first), len(self.words) - 1)
        hot = self.words[at] == first
        return hot, np.where(hot, self.spread[at], np.uint64(1))

    def bucket(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        _, spread = self.is_hot(first)
        return (((first >> np.uint64(17)) + (second >> np.uint64(23)) % spread) % np.uint64(self.buckets)).astype(np.int64)


def even_labels(spark: SparkSession, many: int) -> list[int]:
    """Numbers that hash partitioning sends to ``many`` different partitions, for buckets to be called by."""
    tried = spark.range(40 * many + 200).select("id", F.pmod(F.hash("id"), F.lit(many)).alias("place"))
    found = [r["id"] for r in tried.groupBy("place").agg(F.min("id").alias("id")).collect()]
    return found if len(found) == many else list(range(many))


_PAIRS = ["bucket", "block", "run_words", "run_sizes", "second_words", "second_places", "train_counts",
          "post_counts", "post_docs", "post_times"]


def _dealt_pairs(dealing):
    """Pairs of each block, by bucket: distinct pairs with training counts, and their documents."""

    def run(batches):
        deal = dealing.value
        for number, _, texts, train in _blocks(batches):
            first, second, count = token_pairs(texts)
            doc = np.repeat(np.arange(len(texts), dtype=np.uint32), count)
            bucket = deal.bucket(first, second)
            # Sorted by bucket, first word, second word (by their high bits) and document.
            key = (bucket.astype(np.uint64) << np.uint64(44)) | ((first >> np.uint64(42)) << np.uint64(22)) | (second >> np.uint64(42))
            order = np.argsort(key, kind="stable")
            first, second, doc, bucket = first[order], second[order], doc[order], bucket[order]
            del key, order
            new_pair = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            new_post = new_pair.copy()
            new_post[1:] |= doc[1:] != doc[:-1]
            post = np.flatnonzero(new_post)
            times = np.diff(np.append(post, len(doc)))
            pair = np.flatnonzero(new_pair)
            trained = np.add.reduceat(train[doc].astype(np.int64), pair)
            first, second, bucket = first[pair], second[pair], bucket[pair]
            begin = np.searchsorted(post, pair)  # first posting of each pair
            begin = np.append(begin, len(post))
            docs = doc[post]
            rows = []
            for b, x, y in _cuts(bucket):
                run_at = np.flatnonzero(np.concatenate([[True], first[x + 1:y] != first[x:y - 1]]))
                sorted_words = np.sort(second[x:y])
                vocabulary = sorted_words[np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])]
                p, q = begin[x], begin[y]
                rows.append((
                    deal.labels[b], number, pack(first[x:y][run_at]), pack(np.diff(np.append(run_at, y - x)).astype(np.uint32)),
                    pack_sorted(vocabulary), pack(np.searchsorted(vocabulary, second[x:y]).astype(np.uint32)),
                    pack(trained[x:y].astype(np.uint32)), pack(np.diff(begin[x:y + 1]).astype(np.uint32)),
                    pack(docs[p:q]), pack(times[p:q].astype(np.uint32))))
            yield _binary(rows, _PAIRS, 2)

    return run


def _pairs_of(row) -> tuple[np.ndarray, np.ndarray]:
    first = np.repeat(unpack(row.run_words, np.uint64), unpack(row.run_sizes, np.uint32))
    return first, unpack_sorted(row.second_words)[unpack(row.second_places, np.uint32)]


class Bucket:
    """The distinct pairs of a bucket: sorted hashes, words and training counts."""

    def __init__(self, pdf: pd.DataFrame, dealing: Dealing):
        first, second, counts = [], [], []
        for row in pdf.itertuples(index=False):
            a, b = _pairs_of(row)
            first.append(a)
            second.append(b)
            counts.append(unpack(row.train_counts, np.uint32).astype(np.int64))
        first, second, counts = np.concatenate(first), np.concatenate(second), np.concatenate(counts)
        keys = pair_hashes(first, second)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = keys[at], np.add.reduceat(counts[order], at)
        self.first, self.second = first[order][at], second[order][at]
        # Totals of first words, over the pairs that are here.
        self.contexts, place = self._distinct(self.first)
        seen = [self.counts, self.counts == 1, self.counts == 2, self.counts > 2]
        self.totals = np.stack([np.bincount(place, x, len(self.contexts)).astype(np.int64) for x in seen])
        self.context_of = place
        # Words to ask about: all second words, and first words that are spread.
        self.hot = dealing.is_hot(self.contexts)[0]
        self.words, _ = self._distinct(np.concatenate([self.second, self.contexts[self.hot]]))
        self.word_of = np.searchsorted(self.words, self.second)
        self.hot_word = np.searchsorted(self.words, self.contexts[self.hot])

    @staticmethod
    def _distinct(x: np.ndarray):
        order = np.argsort(x, kind="stable")
        new = np.concatenate([[True], x[order][1:] != x[order][:-1]]) if len(x) else np.zeros(0, bool)
        place = np.empty(len(x), np.int64)
        place[order] = np.cumsum(new) - 1
        return x[order][new], place

    def asked(self, many: int):
        """Order of the words by their bucket, and (bucket, begin, end) in that order."""
        bucket = _word_buckets(self.words, many)
        order = np.argsort(bucket, kind="stable")
        return order, list(_cuts(bucket[order]))


_ASKED = ["bucket", "asker", "n1", "n2", "n3", "n4", "words", "predecessors", "totals"]


def _questions(dealing, many: int):
    """What a bucket tells and asks the buckets of words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        here = Bucket(pdf, dealing.value)
        before = np.bincount(here.word_of[here.counts > 0], minlength=len(here.words))
        totals = np.zeros((4, len(here.words)), np.int64)
        totals[:, here.hot_word] = here.totals[:, here.hot]
        n = [int((here.counts == k).sum()) for k in (1, 2, 3, 4)]
        order, cuts = here.asked(many)
        rows = []
        for b, x, y in cuts:
            some = order[x:y]
            rows.append((b, int(pdf["bucket"].iloc[0]), *n, pack_sorted(here.words[some]), pack(before[some]),
                         pack(np.ascontiguousarray(totals[:, some]).ravel())))
            n = [0] * 4
        return pd.DataFrame(rows, columns=_ASKED)

    return run


_TOLD = ["asker", "bucket", "n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "m3_more", "pairs", "counts", "predecessors", "totals"]


def _answers(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame(columns=_TOLD)
    asked = [unpack_sorted(x) for x in pdf["words"]]
    words, before, *totals = _summed(
        np.concatenate(asked), np.concatenate([unpack(x, np.int64) for x in pdf["predecessors"]]),
        *np.concatenate([unpack(x, np.int64).reshape(4, -1) for x in pdf["totals"]], axis=1))
    counts = np.zeros(len(words), np.int64)
    if len(known):
        vocabulary, n = unpack_sorted(known["words"].iloc[0]), unpack(known["counts"].iloc[0], np.int64)
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        counts = np.where(vocabulary[at] == words, n[at], 0) if len(vocabulary) else counts
    m = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 2).sum()), int(before.sum())]
    rows = []
    for one, row in zip(asked, pdf.itertuples(index=False)):
        at = np.searchsorted(words, one)
        rows.append((row.asker, row.bucket, row.n1, row.n2, row.n3, row.n4, *m, pack(counts[at]), pack(before[at]),
                     pack(np.concatenate([t[at] for t in totals]))))
        m = [0] * 6
    return pd.DataFrame(rows, columns=_TOLD)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2 and more; plain values where counts of counts are missing."""
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.85])


def _pair_log_p(here: Bucket, told: pd.DataFrame, many: int, vocabulary: int):
    """log10 of the model's probability of each pair, and the training count of its second word."""
    p = told.iloc[0]
    order, cuts = here.asked(many)
    counts, before = np.zeros(len(here.words), np.int64), np.zeros(len(here.words), np.int64)
    totals = np.zeros((4, len(here.words)), np.int64)
    answer = {row.bucket: row for row in told.itertuples(index=False)}
    for b, x, y in cuts:
        counts[order[x:y]] = unpack(answer[b].counts, np.int64)
        before[order[x:y]] = unpack(answer[b].predecessors, np.int64)
        totals[:, order[x:y]] = unpack(answer[b].totals, np.int64).reshape(4, -1)
    context = here.totals.copy()
    context[:, here.hot] = totals[:, here.hot_word]
    low, high = discounts(p.m1s, p.m2s, p.m3s, p.m4s), discounts(p.n1s, p.n2s, p.n3s, p.n4s)
    if p.pairs_s:
        spare = (low[1] * p.m1s + low[2] * p.m2s + low[3] * p.m3_more_s) / p.pairs_s
        word_p = np.maximum(before - low[np.minimum(before, 3)], 0) / p.pairs_s + spare / (vocabulary + 1)
    else:
        word_p = np.full(len(before), 1.0 / (vocabulary + 1))
    total, one, two, more = context
    weight = np.where(total > 0, (high[1] * one + high[2] * two + high[3] * more) / np.maximum(total, 1), 1.0)
    at = here.context_of
    probability = (np.maximum(here.counts - high[np.minimum(here.counts, 3)], 0) / np.maximum(total[at], 1)
                   + weight[at] * word_p[here.word_of])
    return np.log10(probability), counts[here.word_of]


def _partial_sums(dealing, many: int, tokens: int, vocabulary: int):
    def run(key, pairs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = ["block", "docs", "score", "base", "known"]
        if not len(pairs):
            return pd.DataFrame(columns=names)
        here = Bucket(pairs, dealing.value)
        log_p, counts = _pair_log_p(here, told, many, vocabulary)
        base = np.log10((counts + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        model = np.stack([here.keys, log_p.view(np.uint64), base.view(np.uint64), (counts > 0).astype(np.uint64)])
        rows = []
        with tempfile.TemporaryFile() as file:  # this part of the model, gone with the task
            model.tofile(file)
            file.flush()
            shape = model.shape
            del here, log_p, counts, base, model
            mapped = np.memmap(file, np.uint64, "r", shape=shape)
            keys, log_p, base, known = mapped[0], mapped[1].view(np.float64), mapped[2].view(np.float64), mapped[3]
            for row in pairs.itertuples(index=False):
                place = np.searchsorted(keys, pair_hashes(*_pairs_of(row)))
                place = np.repeat(place, unpack(row.post_counts, np.uint32))
                docs, times = unpack(row.post_docs, np.uint32), unpack(row.post_times, np.uint32).astype(float)
                n = np.bincount(docs, times)
                some = np.flatnonzero(n)
                sums = [np.bincount(docs, times * x[place])[some] for x in (log_p, base)]
                rows.append((row.block, pack_sorted(some), sums[0].tobytes(), sums[1].tobytes(),
                             pack(np.bincount(docs, times * known[place])[some].astype(np.uint32))))
            del keys, log_p, base, known, mapped
        return pd.DataFrame(rows, columns=names)

    return run


def _block_rows(batches):
    for number, ids, texts, train in _blocks(batches):
        count = np.concatenate([word_hashes(texts[a:b])[1] for a, b in slices(texts, HASH_BYTES)]) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], pa.concat_arrays([ids])),
             pa.array([pack(count.astype(np.uint32))]), pa.array([pack((~train).astype(np.uint8))])],
            ["block", "doc_ids", "counts", "held_out"])


def _scored(tokens: int):
    def run(key, blocks: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(sums):
            raise ValueError("documents were read in other blocks than before")
        block = blocks.iloc[0]
        # Equal blocks have equal documents, so their sums agree; each is scored once.
        copies = len(blocks)
        count = unpack(block.counts, np.uint32).astype(np.int64)
        score, base, known = np.zeros(len(count)), np.zeros(len(count)), np.zeros(len(count))
        for row in sums.itertuples(index=False):
            docs = unpack_sorted(row.docs).astype(np.int64)
            score[docs] += np.frombuffer(row.score)
            base[docs] += np.frombuffer(row.base)
            known[docs] += unpack(row.known, np.uint32)
        out = pd.DataFrame({
            "doc_id": list(block.doc_ids), "held_out": unpack(block.held_out, np.uint8).astype(bool), "n_tokens": count,
            "n_known": np.round(known / copies).astype(np.int64), "train_tokens": tokens,
            "base_score": base / copies, "score": score / copies, "perplexity": 10.0 ** (-score / copies / count)})
        return pd.concat([out] * copies, ignore_index=True)

    return run


def scored(docs: DataFrame, train) -> DataFrame:
    """A row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity.  ``train`` is a condition on docs that tells what to learn from."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.coalesce(train, F.lit(False)).alias("train")).select(
        "doc_id", "text", "train", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("row"))
    many = max(1, 2 * shuffle_partitions(spark))
    words = written(
        texts.mapInArrow(_word_counts(many), "bucket long, words binary, counts binary")
        .groupBy("bucket").applyInPandas(_merged_words, "bucket long, words binary, counts binary, tokens long, types long"),
        "lm-words")
    size = words.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"),).first()
    tokens, vocabulary = size["tokens"] or 0, size["types"] or 0
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    # At most buckets / HOT_PART words are hot.
    least = HOT_PART * tokens / buckets
    hot = words.select("words", "counts").mapInArrow(_hot_words(least), "word long, n long").collect()
    dealing = spark.sparkContext.broadcast(Dealing(even_labels(spark, buckets), {
        r["word"] % (1 << 64): max(2, min(buckets, int(np.ceil(r["n"] / least)))) for r in hot} if buckets > 1 else {}))

    kinds = ", ".join(f"{c} {'long' if c in ('bucket', 'block') else 'binary'}" for c in _PAIRS)
    # Both uses of the dealt pairs read one exchange.
    pairs = texts.mapInArrow(_dealt_pairs(dealing), kinds).repartition(buckets, "bucket")
    longs = {"bucket", "asker", "n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "m3_more", "pairs"}
    asked = pairs.groupBy("bucket").applyInPandas(
        _questions(dealing, many), ", ".join(f"{c} {'long' if c in longs else 'binary'}" for c in _ASKED))
    told = asked.groupBy("bucket").cogroup(words.select("bucket", "words", "counts").groupBy("bucket")).applyInPandas(
        _answers, ", ".join(f"{c} {'long' if c in longs else 'binary'}" for c in _TOLD))
    sums = told.agg(*[F.sum(c).alias(f"{c}{'_s' if c in ('m3_more', 'pairs') else 's'}")
                      for c in ("n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "m3_more", "pairs")]).withColumn("one", F.lit(1))
    told = (
        told.select("asker", "bucket", "counts", "predecessors", "totals").withColumn("one", F.lit(1))
        .join(F.broadcast(sums), "one").drop("one"))  # one row of sums
    partial = pairs.groupBy("bucket").cogroup(told.groupBy("asker")).applyInPandas(
        _partial_sums(dealing, many, tokens, vocabulary), "block long, docs binary, score binary, base binary, known binary")
    blocks = texts.mapInArrow(_block_rows, f"block long, doc_ids array<{id_type}>, counts binary, held_out binary")
    return blocks.groupBy("block").cogroup(partial.groupBy("block")).applyInPandas(
        _scored(tokens),
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, perplexity double")


def op2_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, crc_mod(F.col("doc_id"), 10) != 0)


QUERIES = {"op2_kneser_ney_scores": op2_kneser_ney_scores}
SQL: dict[str, str] = {}
