"""Secret scan: patterns, and novelty measured with zstandard primed by a dictionary.

A candidate is a string of secret characters, letters and digits among them, shortly after or
before a sensitive word.  A compressor is primed with common identifiers and with the text around
the candidate, the candidate and its copies left out, so that a key used twice is reported at both
places; only copies that are called, as ``name(``, stay, since they make it a name.  The bytes
needed for the candidate beyond an empty frame are its marginal size.  Names and paths cost
little, random keys cost about their length: a candidate that stays incompressible is reported as
``novel`` unless a pattern already covers it, or it changes between letters, digits and cases too
seldom to be random (a name of words not met before is incompressible too).

Texts are scanned whole; spans are code points, end exclusive.  A null or empty text has no
spans.  Repeated rows are scanned alike, an empty table gives no rows, other columns play no part.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.base import table

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is matched whole
KINDS = ("assign", "access", "hex", "novel")

#: Words that make their surroundings sensitive, and how far (in code points) they reach.
SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential|bearer|auth(?:orization|_key)", re.A | re.I)
SENSITIVE_PARTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"auth")
REACH = 100
SHORTEST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: Code points on either side that prime the compressor.
AROUND = 1500
#: Share of its own length that a candidate must cost.
NOVEL = 0.75
#: Changes of kind per pair of neighbours below which a candidate is a name, a path or a date.
TURNS = 0.2
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret "
    "authorization bearer credential username user_name user_id session_id request_id "
    "public static final void return import from class def function const let var string "
    "integer boolean null none true false default config settings environment localhost "
    "example test sample placeholder changeme your_api_key_here xxxxxxxxxxxxxxxx "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "https://www.example.com/index.html /usr/local/bin /etc/ssl/certs utf-8 application/json "
    "aws_access_key_id aws_secret_access_key x-api-key content-type"
).encode()
_EMPTY: dict[str, int] = {}


def marginal_bytes(candidate: str, around: str) -> int:
    """Bytes that the candidate adds to a frame primed with identifiers and the text around it."""
    primed = zstandard.ZstdCompressionDict(
        IDENTIFIERS + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False)
    if "size" not in _EMPTY:
        _EMPTY["size"] = len(compressor.compress(b""))
    return len(compressor.compress(candidate.encode())) - _EMPTY["size"]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _surroundings(text: str, start: int, end: int) -> str:
    """The text around a candidate, copies of it blanked, those too that reach over the edge."""
    more = end - start
    before, after = text[max(0, start - AROUND - more):start], text[end:end + AROUND + more]
    for value in {p for p in text[start:end].split("=") if len(p) >= 12}:
        copy, blank = re.compile(re.escape(value) + r"(?!\()"), " " * len(value)
        before, after = copy.sub(blank, before), copy.sub(blank, after)
    return before[-AROUND:] + " " + after[:AROUND]


def _candidates(text: str) -> list[tuple[int, int]]:
    """Strings of secret characters after a sensitive word, then those wholly before one.

    Runs of secret characters and words are each found once and merged by position, so the time
    follows the length of the text.
    """
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    found, done, at = [], 0, 0
    for _, word_end in words:
        begin, stop = max(done, word_end), word_end + REACH
        while at < len(runs):
            start, end = max(runs[at][0], begin), runs[at][1]
            if end - start < SHORTEST:  # nothing of it is left after the word
                at += 1
            elif start >= stop:
                break
            else:
                found.append((start, end))
                done, at = end, at + 1
    word_starts, begins, after = [s for s, _ in words], [s for s, _ in found], len(found)
    for start, end in runs:
        following = bisect.bisect_left(word_starts, end)
        if following == len(words):
            break
        if word_starts[following] - end < REACH:
            before = bisect.bisect_left(begins, end, 0, after)
            if not before or found[before - 1][1] <= start:
                found.append((start, end))
    return found


def turns(value: str) -> float:
    """How often the kind of character changes between neighbours: letters to digits, back, or
    small to capital.  Names and dates seldom do so, random keys in nearly every second place."""
    changes = pairs = 0
    for part in _PARTS.split(_MOMENT.sub("-", value)):
        pairs += max(0, len(part) - 1)
        changes += len(_CHANGE.findall(part))
    return changes / pairs if pairs else 0.0


_MOMENT = re.compile("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9-]*Z?")
_PARTS = re.compile("[^A-Za-z0-9]+")
_CHANGE = re.compile("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])")


def novel_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    starts, reach = [s for s, _, _ in known], list(itertools.accumulate((e for *_, e in known), max))
    found = []
    for start, end in _candidates(text):
        value = text[start:end]
        if turns(value) < TURNS or not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
            continue
        before = bisect.bisect_left(starts, end)
        if before and reach[before - 1] > start:  # a pattern covers some of it
            continue
        if marginal_bytes(value, _surroundings(text, start, end)) >= NOVEL * len(value):
            found.append((start, 3, end))
    return found


def scan(text: str, raw: bytes) -> tuple[list, list]:
    """Spans of the patterns, and all spans, by start and kind; ``raw`` is the text in UTF-8."""
    lowered = raw.lower()
    sensitive = any(p in lowered for p in SENSITIVE_PARTS)
    if sensitive:
        base = base_spans(text)
        return base, sorted(base + novel_spans(text, base))
    base = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if b"AKIA" in raw else []
    base = sorted(base + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])
    return base, base


def _scanned(batches):
    for batch in batches:
        column = batch.column("text")
        starts, ends, kinds = [], [], []
        for raw in column.cast(pa.binary()).to_pylist():
            raw = raw or b""
            _, spans = scan(raw.decode("utf-8", "replace"), raw)
            starts.append([s[0] for s in spans])
            ends.append([s[2] for s in spans])
            kinds.append([KINDS[s[1]] for s in spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
             pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "starts", "ends", "kinds"])


def secrets(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id and ``spans``, an array of (kind, start, end) by start and kind."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _scanned, f"doc_id {id_type}, starts array<bigint>, ends array<bigint>, kinds array<string>")
    spans = F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end"))
    return found.select("doc_id", spans.cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("spans"))


def op7_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = listed(F.filter("spans", lambda s: s["kind"] != "novel"))
    return secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"),
        number("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        number("novel").alias("n_novel"))


QUERIES = {"op7_zstd_novelty_secrets": op7_zstd_novelty_secrets}
SQL: dict[str, str] = {}
