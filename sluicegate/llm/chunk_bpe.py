"""BPE encoding with reuse of content-defined chunks.

A text is cut at white space where a rolling hash of the bytes before it says so, hence the same
passage is cut alike in every document, and the chunks a task has met are looked up instead of
encoded.  A chunk met for the first time is cut again, at every white space, and only pieces
never met are given to the tokenizer.  Joining chunks or pieces is exact only if the tokenizer
sees nothing across the cut, so every join is verified: joins are told apart by the characters
on either side of the cut, the first of each sort is re-encoded with both pieces in one string
and compared.  Joins that disagree are repaired: the pieces around them are re-encoded together,
and the window grows until it agrees with its neighbours, in the end to the whole text.  White
space at either end of a text is a join too.  For a tokenizer that encodes white space as such,
no cut agrees and the window is the whole text from the start.

Reuse is per task and its memory is bounded (``CACHE_BYTES``): a full cache forgets its chunks and
the pieces met only once, which costs time but changes nothing.

A null text counts as empty: no ids, and the empty text decoded.  Texts are encoded whole.
Repeated rows give equal results, an empty table no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.base import SPACES, prefix_hashes, releasing, slices, table, values

#: Bytes under the rolling hash, and hash bits that must be zero: chunks of about 64 words.
WINDOW, CUT_BITS = 16, 6
#: Bytes of memory that a task spends on chunks and pieces, about, and of texts it works on at a time.
CACHE_BYTES, BATCH_BYTES = 50_000_000, 1_000_000
#: Bytes that a piece and a chunk take besides their texts: objects, dictionary entries, ids.
PIECE_COST, CHUNK_COST = 280, 250
#: Different characters at the edges of pieces, at most, that outlive a full cache.
MOST_EDGES = 3000


def chunks(texts: list[bytes]) -> list[list[bytes]]:
    """Each text cut at white space after content-defined places."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    blank = space[data]
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1  # the white space after a word
    sums, inverse = prefix_hashes(data)
    begin = np.maximum(ends - WINDOW, 0)
    # The top bits depend on all bytes of the window.
    rolled = (sums[ends] - sums[begin]) * inverse[begin]
    cuts = ends[rolled >> np.uint64(64 - CUT_BITS) == 0]
    size = np.array([len(t) + 1 for t in texts], np.int64)
    stop = np.cumsum(size)
    first = np.searchsorted(cuts, stop - size, side="right")
    last = np.searchsorted(cuts, stop - 1, side="left")
    out = []
    for i, t in enumerate(texts):
        at = [0, *(cuts[first[i]:last[i]] - (stop[i] - size[i])).tolist(), len(t)]
        out.append([t[a:b] for a, b in zip(at, at[1:])])
    return out


class ChunkEncoder:
    """A tokenizer with its table of pieces and chunks."""

    def __init__(self, tokenizer, cache_bytes: int = CACHE_BYTES):
        self.tokenizer, self.cache_bytes = tokenizer, cache_bytes
        self.safe: dict[tuple[int, int], bool] = {}
        # Without a decoder, decoding puts one space between tokens, so decoded pieces can be joined.
        self.joins_decoded = tokenizer.decoder is None
        self.blind = not any(self._direct([SPACES, *(bytes([c]) * n for c in SPACES for n in (1, 2))]))
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.chunk_pieces: dict[bytes, np.ndarray] = {}
        self.ids = np.zeros(0, np.uint32)
        self.offset, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.decoded: list[bytes] = []
        self.edges: dict[str, int] = {}
        self.known = np.zeros((64, 64), np.int8)  # joins by edge characters: 0 new, 1 agrees, 2 does not
        self.used = np.zeros(0, np.int64)
        self.held = 0

    def _shrink(self) -> None:
        """Forget all chunks and the pieces met once, or if these are many, met least."""
        keep = np.flatnonzero(self.used > 1)
        most = self.cache_bytes // (2 * PIECE_COST)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[:most]])
        length = self.length[keep]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        self.ids = self.ids[np.repeat(self.offset[keep] - (end - length), length) + np.arange(total)]
        self.offset, self.length, self.first, self.last = end - length, length, self.first[keep], self.last[keep]
        self.used = self.used[keep] // 2
        self.texts = [self.texts[i] for i in keep.tolist()]
        self.decoded = [self.decoded[i] for i in keep.tolist()]
        self.pieces = {t: i for i, t in enumerate(self.texts)}
        self.chunk_pieces = {}
        self.held = sum(map(len, self.texts)) + PIECE_COST * len(self.texts)
        if len(self.edges) > MOST_EDGES:
            self.forget()

    def _direct(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _add_pieces(self, new: list[bytes]) -> None:
        if not new:
            return
        encoded = self._direct(new)
        length = np.array([len(e) for e in encoded], np.int64)
        flat = np.fromiter((x for e in encoded for x in e), np.uint32, int(length.sum()))
        self.offset = np.concatenate([self.offset, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, flat])
        self.decoded += [d.encode() for d in self.tokenizer.decode_batch(encoded, skip_special_tokens=False)]
        edges = self.edges
        texts = [p.decode() for p in new]
        self.first = np.concatenate([self.first, np.array([edges.setdefault(t[0], len(edges)) for t in texts], np.int64)])
        self.last = np.concatenate([self.last, np.array([edges.setdefault(t[-1], len(edges)) for t in texts], np.int64)])
        self.texts += new
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])

    def _look_up(self, texts: list[bytes]) -> list[np.ndarray]:
        """Pieces of each text, as numbers."""
        cut = chunks(texts)
        split, new = {}, []
        pieces, known = self.pieces, self.chunk_pieces
        for parts in cut:
            for chunk in parts:
                if chunk in known or chunk in split:
                    continue
                words = split[chunk] = chunk.split()
                self.held += len(chunk) + CHUNK_COST
                for w in words:
                    if w not in pieces:
                        pieces[w] = len(pieces)
                        new.append(w)
                        self.held += len(w) + PIECE_COST
        self._add_pieces(new)
        for chunk, words in split.items():
            known[chunk] = np.array([pieces[w] for w in words], np.int32)
        empty = np.zeros(0, np.int32)
        return [np.concatenate([empty, *(known[c] for c in parts)]) for parts in cut]

    def _verify(self, pieces: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Whether the join after each piece agrees; ``joined`` tells which places are joins."""
        n = len(self.edges)
        if n > len(self.known):
            grown = np.zeros((2 * n, 2 * n), np.int8)
            grown[:len(self.known), :len(self.known)] = self.known
            self.known = grown
        left, right = self.last[pieces[:-1]], self.first[pieces[1:]]
        new = np.flatnonzero(joined & (self.known[left, right] == 0))
        if len(new):
            sort, place = np.unique(left[new] * n + right[new], return_index=True, sorted=True)
            pairs = [(int(pieces[new[p]]), int(pieces[new[p] + 1])) for p in place]
            seen = self._direct([
                end + self.texts[a] + gap + self.texts[b] + end for a, b in pairs for gap, end in ((b" ", b""), (SPACES, SPACES))])
            for k, (a, b) in enumerate(pairs):
                apart = self._ids_of(a) + self._ids_of(b)
                good = seen[2 * k] == apart and seen[2 * k + 1] == apart
                self.known[sort[k] // n, sort[k] % n] = 1 if good else 2
        return self.known[left, right] != 2

    def _ids_of(self, piece: int) -> list[int]:
        at = int(self.offset[piece])
        return self.ids[at:at + int(self.length[piece])].tolist()

    def repaired(self, text: bytes, agrees: np.ndarray) -> list[int]:
        """Ids of a text some of whose joins disagree."""
        words = text.split()
        groups, begin = [], 0
        for i in range(1, len(words) + 1):
            if i == len(words) or agrees[i - 1]:
                groups.append([begin, i])
                begin = i
        # White space as it is in the text, for re-encoding a window.
        spans, at = [], 0
        for w in words:
            at = text.index(w, at)
            spans.append((at, at + len(w)))
            at += len(w)

        def encoded(a: int, b: int) -> list[int]:
            return self._direct([text[spans[a][0] if a else 0:spans[b - 1][1] if b < len(words) else len(text)]])[0]

        done = [(a, b, encoded(a, b)) for a, b in groups]
        k = 0
        while k < len(done) - 1:
            (a, m, left), (_, b, right) = done[k], done[k + 1]
            if b - a <= 2 or encoded(a, b) == left + right:  # single pieces were verified
                k += 1
                continue
            done[k:k + 2] = [(a, b, encoded(a, b))]
            k = max(0, k - 1)
        return [x for *_, e in done for x in e]

    def encode(self, texts: list[bytes]):
        """Ids of each text, and the decoded text in UTF-8."""
        for a, b in slices(texts, BATCH_BYTES):
            if self.held > self.cache_bytes:
                self._shrink()
            yield from self._encode(texts[a:b])

    def _encode(self, texts: list[bytes]):
        if not self.blind:
            for ids in map(self._direct, ([t] for t in texts)):
                yield np.array(ids[0], np.uint32), self.tokenizer.decode(ids[0], skip_special_tokens=False).encode()
            return
        rows = self._look_up(texts)
        pieces = np.concatenate([np.zeros(0, np.int32), *rows])
        self.used += np.bincount(pieces, minlength=len(self.used))
        stop = np.cumsum([len(r) for r in rows])
        agrees = np.ones(max(0, len(pieces) - 1), bool)
        if len(pieces) > 1:
            joined = np.ones(len(pieces) - 1, bool)
            joined[stop[(stop > 0) & (stop < len(pieces))] - 1] = False
            agrees = self._verify(pieces, joined) | ~joined
        broken = set((np.searchsorted(stop, np.flatnonzero(~agrees), side="right")).tolist())
        length = self.length[pieces]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        ids = self.ids[np.repeat(self.offset[pieces] - (end - length), length) + np.arange(total)]
        upto = np.concatenate([[0], end])
        begin = 0
        for i, (text, close) in enumerate(zip(texts, stop.tolist())):
            if i in broken:
                own = np.array(self.repaired(text, agrees[begin:close - 1]), np.uint32)
            elif close - begin == 1 and len(text) > len(self.texts[rows[i][0]]):
                own = np.array(self._direct([text])[0], np.uint32)  # one piece and the white space at its ends
            else:
                own = ids[upto[begin]:upto[close]]
            if i in broken or not self.joins_decoded:
                yield own, self.tokenizer.decode(own.tolist(), skip_special_tokens=False).encode()
            else:
                decoded = self.decoded
                yield own, b" ".join([d for p in rows[i].tolist() if (d := decoded[p])])
            begin = close


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str | None) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    path = path or default_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(load_tokenizer(path))
    return _ENCODERS[path]


def _encoded(path: str | None, digests: bool):
    def run(batches):
        encoder = _encoder(path)
        encoder.forget()
        for batch in batches:
            texts = values(batch.column("text"))
            for a, b in slices(texts, BATCH_BYTES):  # small batches: ids and decoded text are larger than the text
                ids, decoded, count = [], [], []
                for own, text in encoder.encode(texts[a:b]):
                    count.append(len(own))
                    ids.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest() if digests else own.astype(np.int32))
                    decoded.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(count, pa.int64()),
                     pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"])
        encoder.forget()  # the worker may serve other stages next

    return releasing(run)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_tokens, ids array<int>, decoded."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _encoded(path, False), f"doc_id {id_type}, n_tokens long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As ``encoded``, ids and decoded text as SHA-256 digests taken where they are made."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _encoded(path, True), f"doc_id {id_type}, n_tokens long, ids string, decoded string")


def op5_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


QUERIES = {"op5_chunk_reuse_bpe": op5_chunk_reuse_bpe}
SQL: dict[str, str] = {}
