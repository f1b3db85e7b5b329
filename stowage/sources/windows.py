"""What windows of bytes say when a walk has lost its way: headers on and off the grid, zeros, and at which phase floats make sense.

A tar member's data begin at a multiple of 512 bytes, so headers elsewhere, or numbers that are plausible at another phase than
those around them, are bytes that came from another place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Reader, Stored
from .tar import BLOCK, valid

#: Where a header says "ustar", and the sizes between which a number of data is plausible.
MAGIC, MAGIC_AT = b"ustar", 257
SMALLEST, LARGEST = 1e-8, 1e4
#: Bytes that a window reads beyond its end, so that a header over the border is seen in the window where it begins.
BEYOND = BLOCK - 1
#: Windows that one task reads in order.
TOGETHER = 64
REPORT = "path string, at long, length long, magic int, aligned int, unaligned int, first_unaligned long, shift int, zeros long, phases array<double>"


def headers(data: bytes, base: int, length: int) -> tuple[int, list[int], list[int]]:
    """(magic words, offsets of valid headers on the grid, of those off it), of what begins in the first ``length`` bytes; ``base``: the window's offset."""
    magic, on, off = 0, [], []
    k = data.find(MAGIC)
    while k >= 0:
        begin = k - MAGIC_AT
        if 0 <= begin < length:
            magic += 1
            if valid(data[begin : begin + BLOCK]):
                (off if (base + begin) % BLOCK else on).append(base + begin)
        k = data.find(MAGIC, k + 1)
    return magic, on, off


def phases(data: bytes) -> list[float | None]:
    """Share of plausible little-endian floats (zero, or of a sensible size) at each of the four phases; null for fewer than 16 of them."""
    out: list[float | None] = []
    for p in range(4):
        n = (len(data) - p) // 4
        if n < 16:
            out.append(None)
            continue
        with np.errstate(invalid="ignore"):
            x = np.abs(np.frombuffer(data, "<f4", n, p))
            out.append(float(((x == 0) | ((x > SMALLEST) & (x < LARGEST))).mean()))
    return out


def report(spark: SparkSession, files: list[Stored], window: int = 1 << 20) -> DataFrame:
    """A row for each window of each file: (path, at, length, magic, aligned, unaligned, first_unaligned, shift, zeros, phases, best_phase, best_share).

    shift: by how many bytes the first header off the grid is off it.  best_phase: where most numbers are plausible, the first of equal ones.
    Windows are read by tasks in their order, each once and a little beyond; no bytes go through the driver.
    """
    told = spark.createDataFrame([(f.path, f.size) for f in files], "path string, size long")
    each = told.filter("size > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(window).cast("long"))))
    dealt = each.withColumn("stretch", F.floor(F.col("at") / F.lit(window * TOGETHER))).repartition("path", "stretch").sortWithinPartitions("path", "at")

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            out = []
            for path, size, at in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "at"))):
                length = min(window, size - at)
                data = reader.fetch(path, at, min(length + BEYOND, size - at))
                magic, on, off = headers(data, at, length)
                own = data[:length]
                out.append((path, at, length, magic, len(on), len(off), off[0] if off else None, off[0] % BLOCK if off else None, own.count(0), phases(own)))
            columns = zip(*out) if out else [[]] * 10
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [c.split()[0] for c in REPORT.split(", ")])
        reader.close()

    found = dealt.select("path", "size", "at").mapInArrow(analyse, REPORT)
    best = F.array_max("phases")
    return found.withColumns({"best_phase": (F.array_position("phases", best) - 1).cast("int"), "best_share": best})
