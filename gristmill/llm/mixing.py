"""Mixing sources to target weights by capped water-filling.

Sources by code point, null last, get weights in turn. All share `total` words by weight; a source stops at `max_epochs`
times its own size, and what it leaves is shared again by weight until no source is above its cap. Every document of a source is taken its whole number of epochs. For
the fraction that is left, documents stand in the order of a seeded draw, and those are taken once more whose words, added up in that order, fit the rest of the target; the one
at the boundary gives the fraction of its words that still fits. So a source's sum meets its target to the word. Both samplers, of words and of documents, take the same documents.

Nulls: a null text has no words, a null source is a source of its own (the last), a null doc_id draws as the text 'null' would.
Repeated rows draw alike; equal ones (same id, source and size) at the boundary give equal shares, each rounded to a word. An empty table gives an empty result. Other columns of the input never
meet those made here, as only doc_id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, n_words, small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Ranges that a stretch of draws is split into, and how often: words are summed by range, and only the range that holds the boundary is split on. The rows of the last are put in order.
RANGES, SPLITS = 128, 2


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the seed and the id alone: 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank (from 0) in the order of their code points, null last. Ranges are numbered apart and offset by the counts before them, so no task sees all."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = cut(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_part = Window.partitionBy("part").orderBy(*order)
    return parts.join(F.broadcast(offsets), "part").select("source", "source_size", (F.row_number().over(in_part) - 1 + F.col("offset")).alias("rank"))


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, epochs, from (source, size) rows. Each round of the water-filling is a sum over one row a source;
    the driver gets three numbers. A source that is clamped stays so, as the level only rises."""
    if max_epochs < share:
        raise ValueError("the caps of all sources are below what they should share")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked(sources).withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")))
    wanted = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, free = 0.0, None
    while True:
        clamped = F.col("cap") <= F.lit(level) * F.col("weight")
        row = table.agg(F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)), F.count(F.when(~clamped, 1))).first()
        if row[2] == free or not row[1]:
            break
        level, free = (wanted - row[0]) / row[1], row[2]
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return table.select("source", F.col("source_size"), target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("epochs"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def place(rows: DataFrame, seed: str) -> Column:
    """Where a row stands in its source."""
    return F.struct(draw(F.col("doc_id"), seed).alias("draw"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.col("size").alias("size"))


def thresholds(rows: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """of, source_size, target, epochs, bound, bound_words of each source: rows before bound are taken once more, rows at it give so many words, later ones none. No more than RANGES sums
    of a source, and the rows of its last range, are put in order."""
    rest = sources.select(F.col("source").alias("of"), "source_size", "target", "epochs", ((F.col("epochs") - F.floor("epochs")) * F.col("source_size")).alias("room"))
    placed = rows.select("source", "size", place(rows, seed).alias("place"))
    inside = rest.select("of", "room", F.lit(0).cast("long").alias("range"), F.lit(0).cast("long").alias("start"))
    number = lambda k: F.floor(F.col("place.draw") * F.lit(float(RANGES**k)))

    def within(k: int) -> DataFrame:
        return placed.join(small(inside), F.col("source").eqNullSafe(F.col("of")) & (number(k) == F.col("range")))

    for k in range(1, SPLITS + 1):
        sums = within(k - 1).groupBy("of", "room", "start", number(k).alias("range")).agg(F.sum("size").alias("words"))
        before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.withColumn("start", F.col("start") + F.coalesce(F.sum("words").over(before), F.lit(0)))
        inside = cut(starts.where((F.col("start") <= F.col("room")) & (F.col("room") < F.col("start") + F.col("words"))).select("of", "room", "range", "start"), ids=True)
    groups = within(SPLITS).groupBy("of", "room", "start", "place").agg(F.count(F.lit(1)).alias("copies"))
    words = F.col("copies") * F.col("place.size")
    so_far = Window.partitionBy("of").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    left = groups.withColumn("left", F.col("room") - F.col("start") - F.coalesce(F.sum(words).over(so_far), F.lit(0))).where((F.col("left") >= 0) & (F.col("left") < words))
    found = left.select(F.col("of").alias("at"), F.col("place").alias("bound"), F.floor(F.col("left") / F.col("copies") + 0.5).alias("bound_words"))
    return cut(rest.drop("room").join(found, F.col("of").eqNullSafe(F.col("at")), "left").drop("at"), ids=True)


def mixed(docs: DataFrame, rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: str) -> DataFrame:
    """docs (doc_id, source, size, and more) beside of, source_size, target, whole and more (words beyond whole epochs). rows: doc_id, source, size of the same documents."""
    bounds = thresholds(rows, plan(rows, weights, share, max_epochs), seed)
    joined = docs.join(small(bounds), F.col("source").eqNullSafe(F.col("of")))
    here = place(docs, seed)
    more = F.when(here < F.col("bound"), F.col("size")).when(here == F.col("bound"), F.col("bound_words")).otherwise(F.lit(0))
    return joined.withColumn("whole", F.floor("epochs")).withColumn("more", more)


def mix_words(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, source, text); taken counts words with repetitions."""
    rows = cut(sized(docs))
    taken = F.col("whole") * F.col("size") + F.col("more")
    return mixed(rows, rows, weights, share, max_epochs, seed).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it: its source's whole epochs, and once more before the boundary, or at it if half its words or more fit. The columns stay."""
    held = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = mixed(held, cut(sized(docs)), weights, share, max_epochs, seed)
    times = F.col("whole") + F.when((F.col("more") > 0) & (F.col("more") * 2 >= F.col("size")), 1).otherwise(0)
    return found.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: DuckDB SQL for mix_words with the defaults, for a table documents. Sources by ratio of cap to weight are clamped in turn, so the level is found by running sums.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sources
), weighed AS (
  SELECT source, source_size, rk, 2.0::DOUBLE * source_size AS cap, [3.0, 1.0, 2.0][1 + (rk - 1) % 3]::DOUBLE AS weight FROM ranked
), running AS (
  SELECT cap, weight, coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from, sum(source_size) OVER () AS total FROM weighed
), level AS (
  SELECT coalesce(max((1.5::DOUBLE * total - cap_before) / weight_from) FILTER (WHERE (1.5::DOUBLE * total - cap_before) / weight_from < cap / weight), 0) AS level FROM running
), targets AS (
  SELECT source, source_size, least(cap, level * weight) AS target, CASE WHEN source_size > 0 THEN least(cap, level * weight) / source_size ELSE 0 END AS epochs FROM weighed, level
), drawn AS (
  SELECT source, size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, doc_id, CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 AS draw FROM sized
), groups AS (
  SELECT source, size, id, draw, count(*) AS copies FROM drawn GROUP BY ALL
), summed AS (
  SELECT *, coalesce(sum(copies * size) OVER (PARTITION BY source ORDER BY draw, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM groups
)
SELECT d.doc_id, d.size, t.source_size, t.target,
  CAST(floor(t.epochs) * d.size + greatest(0, least(d.size, floor(((t.epochs - floor(t.epochs)) * t.source_size - s.before) / s.copies + 0.5))) AS BIGINT) AS taken
FROM drawn d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source JOIN summed s ON d.source IS NOT DISTINCT FROM s.source AND d.size = s.size AND d.id = s.id
"""
