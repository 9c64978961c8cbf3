"""Language identification by interpolated Kneser-Ney character models.

One model per learned language.  All n-grams of an order that any language knows are one sorted
array of hashes beside a matrix of log probabilities, a column per language, with discounts and
interpolation already applied; contexts have a second array with their back-off weights.  The
prediction is the language of the lowest cross-entropy per character.  ``score`` is its
probability under a temperature fitted on documents kept out of the counts.  ``rejected`` tells
that the text is further from the learned languages than calibration documents are, even if each
stretch of ``STRETCH`` characters may be in the language that suits it best, so that a quotation
in another learned language rejects nothing.

The models are fitted on a bounded sample, whole documents only: per language the
``SAMPLE_DOCS`` documents first in a seeded order, up to ``SAMPLE_CHARS`` characters together.
Documents of more than one ``LONG_SHARE``-th of those characters come after all others, the
shortest first, so that a long text never takes the place of another; the first document is
always taken, however long, so that a language with any labelled letter has a model.  One in ``CALIBRATION_EVERY`` of them is not counted but calibrates.  Everything else reads all
rows and whole texts.

A null text, or one without a letter, is ``und`` with score 0 and is rejected; so is everything
if no labelled text was given.  Ties go to the first language by name.  A null doc_id counts as
the empty text where documents are split.  Repeated rows are scored alike; an empty table gives
no rows.  Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicegate.llm.base import crc_mod, releasing, restricted, table, written

ORDER = 4
SAMPLE_DOCS, SAMPLE_CHARS, CALIBRATION_EVERY = 1800, 7_000_000, 6
#: A document of more than this part of the sample's characters waits until the shorter ones are in.
LONG_SHARE = 100
#: Deviations from the mean cross-entropy beyond which a text is rejected, at least.
REJECT_DEVIATIONS = 8.0
#: Characters that may be in a language of their own.
STRETCH = 128
#: Characters scored at a time.
BLOCK_CHARS = 200_000
#: Bytes of text that a task takes out of an Arrow batch at a time.
SLICE_BYTES = 2_000_000
SPACE = 32

_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
     0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_ALPHABETIC: list[np.ndarray] = []


def _alphabetic() -> np.ndarray:
    if not _ALPHABETIC:
        _ALPHABETIC.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHABETIC[0]


def characters(texts: list[str], order: int):
    """Lower-cased letters of all texts, other characters as one space.

    Returns codes, which of them are to be predicted, and the text each belongs to; every text
    starts with ``order - 1`` spaces that are only context.
    """
    lowered = [t.lower() for t in texts]
    pad = " " * (order - 1)
    codes = np.frombuffer("".join(pad + t for t in lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_alphabetic()[codes], codes, SPACE)
    size = np.array([len(t) + order - 1 for t in lowered], np.int64)
    begin = np.cumsum(size) - size
    padding = np.zeros(len(codes), bool)
    padding[(begin[:, None] + np.arange(order - 1)).ravel()] = True
    keep = codes != SPACE
    keep[1:] |= keep[:-1].copy()  # a space after a letter
    keep |= padding
    owner = np.repeat(np.arange(len(texts)), size)[keep]
    return codes[keep], ~padding[keep], owner


def gram_keys(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` codes that end at each place (the first places hold fewer)."""
    keys = codes.astype(np.uint64) * _MULTIPLIERS[0]
    for j in range(1, order):
        keys[j:] += codes[:-j].astype(np.uint64) * _MULTIPLIERS[j]
    return keys


def _blocks(texts: list[str], most: int):
    """Pieces of texts and the text of each, up to ``most`` characters together."""
    part, who, size = [], [], 0
    for i, text in enumerate(texts):
        for begin in range(0, len(text), most):
            piece = text[begin:begin + most]
            if part and size + len(piece) > most:
                yield part, who
                part, who, size = [], [], 0
            part.append(piece)
            who.append(i)
            size += len(piece)
    if part:
        yield part, who


@dataclass
class HashArray:
    """Sorted hashes with a value row each; ``start`` is where the hashes of each high part begin."""

    keys: np.ndarray
    values: np.ndarray
    start: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> HashArray:
        bits = max(1, len(keys).bit_length() + 1)
        shift = 64 - bits
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(shift)
        return cls(keys, rows.astype(np.float32), np.searchsorted(keys, edges).astype(np.int32), shift)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is absent."""
        found = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return found
        at = self.start[wanted >> np.uint64(self.shift)].astype(np.int64)
        todo = np.arange(len(wanted))
        while len(todo):
            inside = at < len(self.keys)
            todo, at = todo[inside], at[inside]
            here, want = self.keys[at], wanted[todo]
            hit = here == want
            found[todo[hit]] = at[hit]
            more = here < want
            todo, at = todo[more], at[more] + 1
        return found


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: list[HashArray]  # by order - 1
    contexts: list[HashArray]
    floor: float  # log probability of any character, without context
    beta: float = 1.0
    mean: np.ndarray | None = None  # calibration, by language
    spread: np.ndarray | None = None
    per_char: np.ndarray | None = None
    limit: float = REJECT_DEVIATIONS

    def _log_p(self, order: int, keys: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        if not order:
            return np.full((len(at), len(self.languages)), self.floor, np.float32)
        place = self.grams[order - 1].find(keys[order][at])
        out = self.grams[order - 1].values[place]  # of misses set below
        miss = np.flatnonzero(place < 0)
        if len(miss):
            rest = at[miss]
            lower = self._log_p(order - 1, keys, rest)
            weight = self.contexts[order - 1].find(keys[order - 1][rest - 1])
            known = weight >= 0
            lower[known] += self.contexts[order - 1].values[weight[known]]
            out[miss] = lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: cross-entropy per character by language (nats), the same with the best
        language of each stretch, number of characters predicted, and whether it has a letter.
        A text longer than a block is read block by block, with what went before as context."""
        n = len(texts)
        sums, count = np.zeros((n, len(self.languages) + 1)), np.zeros(n, np.int64)
        lettered = np.zeros(n, bool)
        most = BLOCK_CHARS
        for part, who in _blocks([t if len(t) <= most else "" for t in texts], most):
            self._add(part, np.array(who), sums, count, lettered)
        for i, text in enumerate(texts):
            if len(text) > most:
                sums[i], count[i], lettered[i] = self._long(text, most)
        entropy = -sums / np.maximum(count, 1)[:, None]
        return entropy[:, :-1], entropy[:, -1], count, lettered

    def _add(self, part, who, sums, count, lettered) -> None:
        codes, predicted, owner = characters(part, self.order)
        keys = [np.zeros(len(codes), np.uint64)] + [gram_keys(codes, k) for k in range(1, self.order + 1)]
        at = np.flatnonzero(predicted)
        log_p = self._log_p(self.order, keys, at)
        owner = owner[at]
        np.add.at(count, who, np.bincount(owner, minlength=len(part)))
        if len(at) and self.languages:
            own = np.bincount(owner, minlength=len(part))
            place = np.arange(len(at)) - (np.cumsum(own) - own)[owner]
            start = np.flatnonzero(place % STRETCH == 0)
            stretches = np.add.reduceat(log_p, start, axis=0, dtype=np.float64)
            stretches = np.concatenate([stretches, stretches.max(axis=1)[:, None]], axis=1)
            for j in range(stretches.shape[1]):
                np.add.at(sums[:, j], who, np.bincount(owner[start], stretches[:, j], minlength=len(part)))
        lettered[who[np.bincount(owner, codes[at] != SPACE, minlength=len(part)) > 0]] = True

    def _long(self, text: str, most: int) -> tuple[np.ndarray, int, bool]:
        """Sums, number of characters and letters of one text, block by block."""
        many, start = len(self.languages), self.order - 1
        context = np.full(start, SPACE, np.uint32)
        last, place, lettered = SPACE, 0, False
        total, stretch = np.zeros(many + 1), np.zeros(many)
        for begin in range(0, len(text), most):
            raw = np.frombuffer(text[begin:begin + most].lower().encode("utf-32-le", "surrogatepass"), "<u4")
            raw = np.where(_alphabetic()[raw], raw, SPACE)
            before = np.concatenate([[last], raw[:-1]])
            codes = np.concatenate([context, raw[(raw != SPACE) | (before != SPACE)]]).astype(np.uint32)
            last = int(raw[-1])
            at = np.arange(start, len(codes))
            if not len(at):
                continue
            lettered = lettered or bool((codes[at] != SPACE).any())
            keys = [np.zeros(len(codes), np.uint64)] + [gram_keys(codes, k) for k in range(1, self.order + 1)]
            log_p = self._log_p(self.order, keys, at)
            if many:
                places = place + np.arange(len(at))
                cut = np.flatnonzero((places % STRETCH == 0) | (np.arange(len(at)) == 0))
                parts = np.add.reduceat(log_p, cut, axis=0, dtype=np.float64)
                if place % STRETCH:  # the stretch that the block before began
                    parts[0] += stretch
                elif place:
                    total[-1] += stretch.max()
                total[:-1] += log_p.sum(axis=0, dtype=np.float64)
                total[-1] += parts[:-1].max(axis=1).sum()
                stretch = parts[-1]
            place += len(at)
            context = codes[len(codes) - start:]
        if many and place:
            total[-1] += stretch.max()
        return total, place, lettered

    def deviations(self, best: np.ndarray, entropy: np.ndarray, count: np.ndarray) -> np.ndarray:
        noise = np.sqrt(self.spread[best] ** 2 + self.per_char[best] / np.maximum(count, 1))
        return (entropy - self.mean[best]) / np.maximum(noise, 1e-9)

    def predict(self, texts: list[str]):
        """Language, score, cross-entropy per character and rejection of each text."""
        entropy, mixed, count, lettered = self.entropies(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), [True] * len(texts)
        best = np.argmin(entropy, axis=1)
        low = entropy[np.arange(len(texts)), best]
        gap = (entropy - low[:, None]) * count[:, None] * self.beta
        score = np.where(lettered, 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1), 0.0)
        rejected = ~lettered | (self.deviations(best, mixed, count) > self.limit)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
        return names, score, np.where(lettered, low, 0.0), rejected.tolist()


def _grouped(keys: np.ndarray):
    """Distinct keys in order, the first place of each, and the group of each place."""
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=keys[order][:1] ^ np.uint64(1)) != 0
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return keys[order][new], order[new], inverse


def _keys_of(codes: np.ndarray) -> np.ndarray:
    """Hashes of rows of codes, the last code being the one predicted."""
    k = codes.shape[1]
    return (codes[:, ::-1].astype(np.uint64) * _MULTIPLIERS[:k]).sum(axis=1, dtype=np.uint64)


def fit(languages: list[str], codes: np.ndarray, language: np.ndarray, n: np.ndarray) -> Model:
    """Models from counts of n-grams of the highest order: a row of codes, its language and count."""
    order, many = codes.shape[1], len(languages)
    keys, first, group = _grouped(_keys_of(codes))
    counts = np.zeros((len(keys), many))
    np.add.at(counts, (group, language), n)
    levels = [(codes[first], keys, counts)]
    for _ in range(order - 1):  # lower orders count the different characters before an n-gram
        upper, _, c = levels[0]
        rows = upper[:, 1:]
        keys, first, group = _grouped(_keys_of(rows))
        lower = np.zeros((len(keys), many))
        np.add.at(lower, group, (c > 0).astype(float))
        levels.insert(0, (rows[first], keys, lower))
    floor = -np.log(len(levels[0][1]) + 1.0)
    below = np.full((1, many), np.exp(floor))
    below_keys = np.zeros(1, np.uint64)
    grams, contexts = [], []
    for rows, keys, c in levels:
        once, twice = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        discount = np.where(once > 0, once / np.maximum(once + 2.0 * twice, 1), 0.5)
        discount = np.clip(discount, 0.1, 0.95)
        ctx_keys, _, group = _grouped(_keys_of(rows[:, :-1]))
        total, kinds = np.zeros((len(ctx_keys), many)), np.zeros((len(ctx_keys), many))
        np.add.at(total, group, c)
        np.add.at(kinds, group, (c > 0).astype(float))
        seen = total > 0
        weight = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
        suffix = np.searchsorted(below_keys, _keys_of(rows[:, 1:])) if rows.shape[1] > 1 else np.zeros(len(rows), int)
        p = np.maximum(c - discount, 0) / np.maximum(total[group], 1) + weight[group] * below[suffix]
        grams.append(HashArray.of(keys, np.log(p)))
        contexts.append(HashArray.of(ctx_keys, np.log(weight)))
        below, below_keys = p, keys
    return Model(languages, order, grams, contexts, float(floor))


def calibrate(model: Model, texts: list[str], labels: list[str]) -> Model:
    """Set temperature and rejection limits from labelled texts outside the counts."""
    many = len(model.languages)
    model.mean, model.spread, model.per_char = np.full(many, np.log(30.0)), np.full(many, 1.0), np.full(many, 4.0)
    entropy, mixed, count, lettered = model.entropies(texts)
    truth = np.array([model.languages.index(x) for x in labels], np.int64)
    use = np.flatnonzero(lettered & (count >= 20))
    if not len(use):
        return model
    entropy, mixed, count, truth = entropy[use], mixed[use], count[use], truth[use]
    own = entropy[np.arange(len(use)), truth]
    for j in range(many):
        mine = truth == j
        if mine.sum() >= 5:
            model.mean[j] = np.median(mixed[mine])
            model.spread[j] = max(0.02, 1.4826 * np.median(np.abs(mixed[mine] - model.mean[j])))
    gap = (entropy - own[:, None]) * count[:, None]
    losses = []
    for beta in (2.0 ** -k for k in range(12)):
        losses.append((float(np.log(np.exp(-np.clip(gap * beta, -700, 700)).sum(axis=1)).mean()), beta))
    model.beta = min(losses)[1]
    best = np.argmin(entropy, axis=1)
    off = model.deviations(best, mixed, count)
    # Some labels may be junk: the limit follows the bulk of the texts, not the furthest.
    model.limit = max(REJECT_DEVIATIONS, 2.0 * float(np.quantile(off, 0.9)))
    return model


def _counted(order: int):
    def count(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            out = [[], [], []]
            for lang in sorted(set(langs)):
                own = [t or "" for t, x in zip(texts, langs) if x == lang]
                for part, _ in _blocks(own, SAMPLE_CHARS):
                    codes, predicted, _ = characters(part, order)
                    at = np.flatnonzero(predicted)
                    if not len(at):
                        continue
                    _, first, group = _grouped(gram_keys(codes, order)[at])
                    rows = codes[at[first][:, None] + np.arange(1 - order, 1)]
                    out[0] += [lang] * len(first)
                    out[1] += rows.astype("<u4").tolist()
                    out[2] += np.bincount(group, minlength=len(first)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.int64())],
                ["lang", "gram", "n"])

    return count


def trained(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS,
            sample_chars: int = SAMPLE_CHARS, calibration_every: int = CALIBRATION_EVERY) -> Model:
    """Models of the languages in column ``lang`` of docs, from the bounded sample."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # Long documents come last, by size: the running sum then cuts off none that is shorter.
    late = F.when(F.col("size") * LONG_SHARE > sample_chars, F.col("size")).otherwise(F.lit(0))
    first = Window.partitionBy("lang").orderBy("late", "h", "doc_id", "size")
    sized = labelled.select("doc_id", "lang", F.length("text").alias("size"), h.alias("h")).withColumn("late", late)
    # A language of many documents is thinned by its hash before it is ranked in one place: four times
    # the sample stays, and no long document where the short ones are enough.
    short = sized.groupBy("lang").agg(F.count_if(F.col("late") == 0).alias("short"))
    share = F.lit(4.0 * sample_docs) / F.col("short")
    stays = F.when(F.col("short") < 4 * sample_docs, (F.col("late") == 0) | (F.col("short") < sample_docs)).otherwise(
        (F.col("late") == 0) & (F.col("h").cast("double") / 2.0 ** 64 + 0.5 < share))
    ranked = (
        sized.join(short, "lang").where(stays)
        .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_docs))
    upto = first.rowsBetween(Window.unboundedPreceding, 0)
    # Written, its size is known: Spark then decides by its own check whether to broadcast it.
    picked = written(
        ranked.withColumn("chars", F.sum("size").over(upto))
        .where((F.col("chars") <= sample_chars) | (F.col("rank") == 1))
        .select("doc_id", (F.col("rank") % calibration_every == 0).alias("calibration"))
        .groupBy("doc_id").agg(F.min("calibration").alias("calibration")), "language-sample")
    # What comes to the driver is bounded by the sample: n-grams of it, and the calibration texts.
    counts = (
        restricted(labelled, picked.where("NOT calibration")).select("text", "lang")
        .mapInArrow(_counted(order), "lang string, gram array<int>, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counts["lang"].unique().tolist())
    if not languages:
        return Model([], order, [], [], 0.0)
    codes = np.array(counts["gram"].tolist(), np.uint32).reshape(len(counts), order)
    where = {x: i for i, x in enumerate(languages)}
    model = fit(languages, codes, counts["lang"].map(where).to_numpy(np.int64), counts["n"].to_numpy(np.float64))
    rest = restricted(labelled, picked.where("calibration")).select("text", "lang").collect()
    rest = [r for r in rest if r["lang"] in where]
    return calibrate(model, [r["text"] for r in rest], [r["lang"] for r in rest])


def _spans(column: pa.Array, most: int):
    """Ranges of rows with about ``most`` bytes of text together (one text may be longer)."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(upto):
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, side="right"))
        end = max(end, begin + 1)
        yield begin, end
        begin = end


def _identified(model):
    def predict(batches):
        for batch in batches:
            for a, b in _spans(batch.column("text"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                names, score, entropy, rejected = model.value.predict([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()),
                    pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return releasing(predict)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """A row per row of docs: doc_id, lang_pred, score, cross_entropy, rejected."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _identified(shared),
        f"doc_id {id_type}, lang_pred string, score double, cross_entropy double, rejected boolean")


def training_part(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod(F.col("doc_id"), 4) != 2)


def _accepted(model, place: int):
    def keep(batches):
        for batch in batches:
            for a, b in _spans(batch.column(place), SLICE_BYTES):  # few rows at a time are held in Python
                part = batch.slice(a, b - a)
                *_, rejected = model.value.predict([t or "" for t in part.column(place).cast(pa.string()).to_pylist()])
                yield part.filter(pa.array([not r for r in rejected], pa.bool_()))

    return releasing(keep)


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with their columns."""
    model = docs.sparkSession.sparkContext.broadcast(trained(training_part(docs)))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any names may follow
    return plain.mapInArrow(_accepted(model, docs.columns.index("text")), plain.schema).toDF(*docs.columns)


def op10_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The id decides only which documents are learned from.
    out = identified(docs, trained(training_part(docs)))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
                      "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op10_kneser_ney_language": op10_kneser_ney_language}
SQL: dict[str, str] = {}
