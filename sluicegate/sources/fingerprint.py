"""One fingerprint for files of every size, made from lines by many tasks.

The lines of a file are hashed to numbers h(0), h(1), ... modulo a prime p, and the file to the sums
of h(i) * B^i for a few seeds of the hash, together with its length and the number of its lines.
Such sums can be combined: a block of lines is summed where it is read, by its place in the task,
and shifted to its place in the file by one power of B.  So the fingerprint does not depend on how
the file is cut into blocks, two lines in another order change it, and no task holds a file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sluicegate.sources.landing import FILE, Landing

#: The prime and a primitive root of it: powers repeat after PRIME - 1 lines only.
PRIME, BASE = 2**31 - 1, 16807
SEEDS = (1, 2, 3, 4)
#: Places within a task have 33 bits; powers are looked up eight bits at a time.
PLACE_BITS, DIGIT_BITS = 33, 8


def _power(place: Column) -> Column:
    """BASE ** place modulo PRIME: a product of one table entry per digit of the place."""
    out = None
    for low in range(0, PLACE_BITS, DIGIT_BITS):
        powers = [pow(BASE, digit << low, PRIME) for digit in range(1 << min(DIGIT_BITS, PLACE_BITS - low))]
        entries = F.expr(f"array({', '.join(f'{x}L' for x in powers)})")
        digit = F.shiftright(place, low).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")
        factor = F.element_at(entries, digit + 1)
        out = factor if out is None else (out * factor) % PRIME
    return out


def block_sums(lines: DataFrame, head: Column | None = None) -> DataFrame:
    """Per file and block of ``lines`` (_file, _block, _place, value): place of the first line,
    number of lines, sums, and ``head`` (the text, unless given) of the line where the file begins.

    Lines are sorted to be summed if ``head`` is a text, and not if it is a number.
    """
    head = F.col("value") if head is None else head
    term = [F.pmod(F.xxhash64(F.lit(seed), "value"), F.lit(PRIME)) for seed in SEEDS]
    powered = lines.withColumn("_power", _power(F.col("_place")))
    return powered.groupBy(FILE, "_block").agg(
        F.min("_place").alias("first"), F.count(F.lit(1)).alias("n"),
        *[(F.sum((t * F.col("_power")) % PRIME) % PRIME).alias(f"s{i}") for i, t in enumerate(term)],
        F.min_by(F.when(F.col("_block") == 0, head), "_place").alias("head"))


_FILE_ROW = f"{FILE} string, path string, length long, file_name string, width int, file_hash string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block sums of each file, shifted to their places and added."""
    for batch in batches:
        hashes = []
        for length, blocks in zip(batch.column("length").to_pylist(), batch.column("blocks").to_pylist()):
            before, sums = 0, [0] * len(SEEDS)
            for block in blocks or ():
                shift = pow(BASE, (before - block["first"]) % (PRIME - 1), PRIME)
                sums = [(s + block[f"s{i}"] * shift) % PRIME for i, s in enumerate(sums)]
                before += block["n"]
            text = "|".join(str(x) for x in (length, before, *sums))
            hashes.append(hashlib.sha256(text.encode()).hexdigest())
        kept = [batch.column(c) for c in (FILE, "path", "length", "file_name", "width")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(hashes, pa.string())], [FILE, "path", "length", "file_name", "width", "file_hash"])


def fingerprint_files(landing: Landing, separator: str | None = None) -> DataFrame:
    """A row per file: _file, path, length, file_name, file_hash (64 hexadecimal digits), width.

    ``width`` is the number of separators in the file's first line and one, at least the number of
    its columns; 1 if no separator is given.  A file without a byte has a row too.
    """
    files = landing.files().select(FILE, "path", "length", F.element_at(F.split("path", "/"), -1).alias("file_name"))
    lines = landing.load(landing.spark.read.format("text").option("lineSep", "\n")).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place"), "value")
    marks = F.lit(0) if separator is None else F.length("value") - F.length(F.replace("value", F.lit(separator), F.lit("")))
    sums = block_sums(lines, marks)
    width = F.lit(1) if separator is None else F.max("head") / len(separator) + 1
    per_file = sums.groupBy(FILE).agg(
        F.sort_array(F.collect_list(F.struct("_block", "first", "n", *[f"s{i}" for i in range(len(SEEDS))]))).alias("blocks"),
        width.cast("int").alias("width"))
    joined = files.join(per_file, FILE, "left").withColumn("width", F.coalesce("width", F.lit(1)))
    return joined.select(FILE, "path", "length", "file_name", "width", "blocks").mapInArrow(_digests, _FILE_ROW)
