"""Packing by optimal length buckets: dynamic programming over the global length histogram chooses the boundaries with the least padding;
inside each bucket, batches of a token budget are numbered without gaps.

The histogram is exact: a number for each different length, of which a corpus of W words has at most the root of 2 W. The boundaries are optimal among all
lengths. The top boundary is the largest length: nothing is cut. A document longer than the budget is a batch by itself.

Nulls: a null text has length 0; a null doc_id is packed like any other. Repeated rows are packed each. An empty table gives an empty result.
Numbers within a bucket come from counts of small parts of it, dealt by the rows' places in the checkpointed table, so no task sees a whole bucket, whatever rows are equal. Which documents share
a batch depends on how the input is dealt out; that each has one place does not. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, n_words, small

BUCKETS = 12
BUDGET = 16384
#: Rows of a bucket that one task numbers, about.
PART = 20_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most `buckets` ascending upper boundaries, taken from lengths (ascending), that minimise the sum of boundary times documents.

    best[j] is the least cost of the lengths up to j. With one more bucket, from after i to j, it is x * N - N_i * x + best[i], for the length x and N documents up to j: the least of
    straight lines in x, whose slopes fall with i. As x grows, the lowest line only moves on, so a round takes one walk over the lengths."""
    x, n = [int(v) for v in lengths], len(lengths)
    upto = [0, *np.cumsum(counts).tolist()]
    best = [x[j] * upto[j + 1] for j in range(n)]
    choice = []
    for _ in range(1, min(buckets, n)):
        new, at = best.copy(), [-1] * n
        lines: list[tuple[int, int, int]] = []  # slope, height at 0, i; those before `low` are done with
        low = 0
        for j in range(1, n):
            slope, height = -upto[j], best[j - 1]
            while len(lines) - low >= 2 and (height - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - slope):
                lines.pop()
            lines.append((slope, height, j - 1))
            while low + 1 < len(lines) and lines[low + 1][0] * x[j] + lines[low + 1][1] <= lines[low][0] * x[j] + lines[low][1]:
                low += 1
            cost = lines[low][0] * x[j] + lines[low][1] + x[j] * upto[j + 1]
            if cost < new[j]:
                new[j], at[j] = cost, lines[low][2]
        choice.append(at)
        best = new
    out, j = [], n - 1
    for at in reversed(choice):
        if j >= 0 and at[j] >= 0:
            out.append(x[j])
            j = at[j]
    return [x[j], *reversed(out)] if n else []


def histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(length, documents) of each different length, ascending."""
    found = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("length")
    return found.column("length").to_numpy(), found.column("n").to_numpy()


def pack_lengths(lengths: DataFrame, keep: tuple[str, ...] = ("doc_id",), buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """keep, length, bucket (from 0), bucket_length, batch (its number in the bucket), slot, padding, for rows with a length.

    lengths must give the same rows, dealt alike, when read twice."""
    tops = boundaries(*histogram(lengths), buckets)
    if not tops:
        tops = [0]
    bucket = F.lit(len(tops) - 1)
    for k in range(len(tops) - 2, -1, -1):
        bucket = F.when(F.col("length") <= tops[k], k).otherwise(bucket)
    rows = lengths.select(*keep, "length", bucket.cast("int").alias("bucket"))
    sizes = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `buckets` numbers
    parts = F.element_at(F.array(*[F.lit(1 + sizes.get(k, 0) // PART) for k in range(len(tops))]), F.col("bucket") + 1)
    salted = cut(rows.withColumn("draw", F.xxhash64(F.monotonically_increasing_id())).withColumn("part", F.pmod("draw", parts).cast("long")))
    counts = salted.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_part = Window.partitionBy("bucket", "part").orderBy("draw")
    place = salted.withColumn("row", F.row_number().over(in_part)).join(small(cut(offsets)), ["bucket", "part"])
    top = F.element_at(F.array(*[F.lit(t).cast("long") for t in tops]), F.col("bucket") + 1)
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))))
    numbered = place.withColumn("bucket_length", top).withColumn("at", F.col("offset") + F.col("row") - 1).withColumn("fit", fit)
    return numbered.select(*keep, "length", "bucket", "bucket_length", F.floor(F.col("at") / F.col("fit")).alias("batch"), (F.col("at") % F.col("fit")).alias("slot"), (F.col("bucket_length") - F.col("length")).alias("padding"))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id and its place, for every row of docs (doc_id, text). Lengths are words."""
    return pack_lengths(cut(docs.select("doc_id", n_words(F.col("text")).alias("length"))), buckets=buckets, budget=budget)
