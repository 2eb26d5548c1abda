"""Near-duplicate documents by bottom-k sketches from one hash function.

Each document's set of word shingles, as 64-bit hashes, is kept as its K smallest values (its sketch), its size and a fingerprint. Equal
sets are one class and go on as one. Inverted lists of the retained values give the overlaps:

- Lists of at most LIST classes are cold. Two classes in a cold list are a candidate pair if their sizes allow the similarity.
  The K smallest values of the pair's union, taken from both sketches, estimate the similarity; pairs far below the limit go.
- Longer lists are hot: passages that many documents share, or large groups of near copies. A class with enough cold values (COLD; for sets
  within K, more than any partner's sketch can lack) meets all its partners in cold lists, so hot lists matter only between the other classes.
  Those are joined exactly by prefixes in the order of rarity, as counted in SLOTS slots: a pair at similarity t has its first common value at
  places i + j <= (1-t)/(1+t) of both sizes, whatever the order, and values that nobody else has can't be common. In each list, all first meet one hub; the links found
  join them to components; then only lists that hold several components are compared on, block against block.

Every candidate is verified on full sets. No list, pair or partner is capped. Chances, for one pair that is exactly at similarity 0.8 and joined by
nothing else: 2e-7 that the estimate puts it below (32 draws at 0.8, at most 12 common), and at most 2e-7 that a class beyond K with COLD cold
values shares none of them with its partner's sketch. The latter holds whichever values are cold, the largest ones too, which fall out of longer
variants' sketches: it needs sketches with at most K - COLD = 12 values in common. For sets within K it can't happen. Exposed classes are joined exactly.

Nulls and odd input: null or blank texts have no shingles and link with nothing; a text of fewer words than a shingle is one shingle, its whole
sequence. Rows without doc_id take no part: component null, kept. Rows that share a doc_id are one node, with the links of all of them.
Empty tables give empty results. Only doc_id and text are read; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_in, number_of_partitions, row_map, small
from .graph import components

WORDS = 5
PERCENT = 80
K = 32
LIST = 32
#: Cold values with which a class beyond K need not be joined exactly.
COLD = 20
#: Classes of one family, and values of their sets, that a task compares with as many others.
BLOCK, BLOCK_VALUES = 512, 500_000
#: Classes up to which lists that share members are compared as one family.
FAMILY = 1 << 16
#: Values, columns of a matrix, that are counted at once.
COLUMNS = 4096
#: Hot values up to which they are broadcast, as 64-bit numbers: some 30 MB.
HOT_VALUES = 1_000_000
#: Slots, a power of two, in which values are counted for the order of rarity: one array of this many 32-bit numbers in each process.
SLOTS = 1 << 20
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles, as signed 64-bit numbers."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(h))
    m = len(h) - size + 1
    out = np.full(m, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + m]) * MIX[k % 4] + np.uint64(k)
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def row_sets(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """doc_id, n (size of the set), f1, f2 (its fingerprint), sketch (the k smallest) of each row; narrow."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in batch.column(1)]
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in found), np.int64).reshape(-1, 2)
            sketches = [x[:k] for x in found]
            ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches)) if sketches else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists], names=["doc_id", "n", "f1", "f2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets, "doc_id long, n long, f1 long, f2 long, sketch array<long>")


def fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def estimated(pairs: DataFrame, sketches: DataFrame, percent: int, k: int = K) -> DataFrame:
    """The pairs (a, b) whose union sketch doesn't put them far below the limit. Within k values the sketch is the set and decides; beyond,
    a pair at the limit stays unless it is off by 0.4 or more, which has a chance of 2e-7 for k = 32."""
    one = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    least = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    common = F.size(F.array_intersect(least, F.array_intersect("s_a", "s_b")))
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    # sets within k: all of the union counts, not its k smallest
    both, union = F.size(F.array_intersect("s_a", "s_b")), F.size(F.array_union("s_a", "s_b"))
    keep = F.when(whole, both * 100 >= union * percent).otherwise(common * 100 >= F.size(least) * (percent - 40))
    return pairs.join(one, "a").join(two, "b").where(keep).select("a", "b").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node, values (the set as bytes) and ids' other columns, of the documents in ids (node, and more). Texts of others go before the shuffle, by the slots of their ids."""
    more = [f for f in ids.schema.fields if f.name != "node"]

    def sets(given: Iterator[tuple]) -> Iterable[tuple]:
        for node, text, *rest in given:
            own = shingles(text, words)
            if len(own):
                yield node, own.tobytes(), *rest

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node is not null")
    found = maybe_in(texts, ids, "node").join(ids, "node").select("node", "text", *[f.name for f in more])
    return row_map(found, sets, ", ".join(["node long, values binary", *[f"{f.name} {f.dataType.simpleString()}" for f in more]]))


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are so similar on their full sets (node, values). A hub's set meets its many partners in a join that Spark may split."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("values").alias("v_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("values").alias("v_b")), "b")

    def compare(given: Iterator[tuple]) -> Iterable[tuple]:
        for a, b, x, y in given:
            p, q = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * common >= percent * (len(p) + len(q) - common) > 0:
                yield a, b

    return row_map(both.select("a", "b", "v_a", "v_b"), compare, "a long, b long")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many values of the sets (node, values) fall into each of SLOTS slots. Tasks count for themselves; the driver gets at most SLOTS sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for data in batch.column(0):
                np.add.at(total, np.frombuffer(data.as_buffer(), np.int64) & (SLOTS - 1), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    sums = sets.select("values").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int32)
    out[sums.column("slot").to_numpy()] = np.minimum(sums.column("n").to_numpy(), np.iinfo(np.int32).max)
    return out


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """v, node, n, pos: the rarest values of each set (node, values), as many as a set so similar must share one of. pos counts from 0 in one order for all:
    by the number of values in the value's slot, then by value. A value alone in its slot is in no other set; it takes its place but has no row."""
    shared = sets.sparkSession.sparkContext.broadcast(slot_counts(sets))
    last = SLOTS - 1

    def rows(given: Iterator[tuple]) -> Iterable[tuple]:
        for node, data in given:
            own = np.frombuffer(data, np.int64)
            often = shared.value[own & last]
            first = np.lexsort((own, often))[: len(own) * (100 - percent) // 100 + 1]
            for pos, (v, n) in enumerate(zip(own[first].tolist(), often[first].tolist(), strict=True)):
                if n > 1:
                    yield v, node, len(own), pos

    return row_map(sets.select("node", "values"), rows, "v long, node long, n long, pos long")


def exposed_links(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """known, links (a, b) found before, and the links among the exposed classes (node, values), by an exact prefix join in the order of rarity: links that join the same
    classes, though not each of them comes back. Two classes that known or earlier links already join need no link of their own.

    Lists hold ids. In each, all first meet one hub. What is then left to compare are the lists whose members are not all joined yet: lists that share members make a
    family, and a family's sets meet once, block against block, instead of once a list. A family beyond FAMILY classes is compared list by list, so that
    nothing chained by accident is compared as a whole; the links are the same."""
    prefix = cut(prefixes(sets, percent), ids=True)

    apart = lambda i, j, n, m: (i + j) * (100 + percent) <= (n + m) * (100 - percent)
    # cut, here and below, so that both sides of a join by v are plain exchanges, whose hot values Spark can split
    hubs = cut(prefix.groupBy("v").agg(F.min(F.struct("pos", "node", "n")).alias("hub")), ids=True)
    to_hub = prefix.join(hubs, "v").where((F.col("node") != F.col("hub.node")) & fits(F.col("n"), F.col("hub.n"), percent) & apart(F.col("pos"), F.col("hub.pos"), F.col("n"), F.col("hub.n")))
    first = verified(sets, to_hub.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct(), percent)

    joined = cut(components(known.select("a", "b").union(first)), ids=True)
    marked = cut(prefix.join(joined.withColumnRenamed("id", "node"), "node", "left").select("v", "node", "n", F.coalesce("component", "node").alias("component")), ids=True)
    mixed = cut(marked.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("least")).where("low <> high").select("v", "least"), ids=True)
    lists = cut(marked.join(mixed, "v"), ids=True)
    family = cut(components(lists.select(F.col("least").alias("a"), F.col("node").alias("b"))), ids=True).select(F.col("id").alias("node"), F.col("component").alias("family"))
    sizes = cut(family.groupBy("family").agg(F.count(F.lit(1)).alias("members")), ids=True)
    key = F.when(F.col("members") <= FAMILY, F.struct("family", F.lit(0).cast("long").alias("v"))).otherwise(F.struct("family", "v")).alias("key")
    member = cut(lists.join(family.join(sizes, "family"), "node").select(key, "node", "n", "component").distinct(), ids=True)
    counts = cut(member.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("values")), ids=True)
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.ceil(F.col("values") / F.lit(BLOCK_VALUES))).cast("int")
    dealt = member.join(counts.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "node", "component", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    full = spread.join(sets, "node")
    # by number, so that Spark doesn't join these few but busy rows to one task
    by_block = full.repartition(number_of_partitions(sets.sparkSession), "key", "x", "y")
    more = by_block.groupBy("key", "x", "y").applyInPandas(lambda given: joining(given, percent), "a long, b long").distinct()
    return joined.select(F.col("component").alias("a"), F.col("id").alias("b")).where("a <> b").union(more)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common: a product of 0-1 matrices, COLUMNS values at a time; a value in one set only takes no column."""
    sizes = np.array([len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    keep = shared[column]
    row, column = np.repeat(np.arange(len(sets)), sizes)[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, z = np.searchsorted(column, (low, low + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:z], column[a:z] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def joining(given: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join the components of one block, or of two blocks: (key, x, y, node, component, own, values). Pairs are compared on full sets;
    of the links, one for each joining comes back."""
    given = given.sort_values("node", kind="stable")
    node, group, own = (given[c].to_numpy().copy() for c in ("node", "component", "own"))
    sets = [np.frombuffer(x, np.int64) for x in given["values"]]
    n = np.array([len(x) for x in sets])
    common = common_counts(sets)
    good = np.triu((group[:, None] != group) & (common * 100 >= percent * (n[:, None] + n - common)), 1)
    if given["x"].iloc[0] != given["y"].iloc[0]:
        good &= own[:, None] != own
    found = []
    for k, i in zip(*np.nonzero(good), strict=True):
        if group[i] != group[k]:
            found.append((min(node[k], node[i]), max(node[k], node[i])))
            group[group == group[i]] = group[k]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b (a < b) between classes (node, n, sketch): enough links to join all that are joined by any."""
    postings = classes.select("node", "n", F.explode("sketch").alias("v"))
    hot = cut(postings.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LIST).select("v"), ids=True)
    n_hot = hot.count()
    cold = postings.join(small(hot, n_hot, HOT_VALUES), "v", "left_anti")
    one, two = cold.select("v", F.col("node").alias("a"), F.col("n").alias("n_a")), cold.select("v", F.col("node").alias("b"), F.col("n").alias("n_b"))
    pairs = one.join(two, "v").where((F.col("a") < F.col("b")) & fits(F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct()
    likely = cut(estimated(pairs, classes, percent), ids=True)
    # classes whose cold values may all be among the differences, or beyond a longer partner's sketch: of n <= K values, a partner of m has all but
    # (n - m * t) / (1 + t), and its sketch lacks m - K more; over n * t <= m <= n / t that is n * (1 - t) or n / t - K at most
    share = postings.join(small(hot, n_hot, HOT_VALUES), "v", "left_semi").groupBy("node", "n").agg(F.count(F.lit(1)).alias("hot"))
    retained = F.least(F.col("n"), F.lit(K))
    own = retained - F.col("hot")
    few = F.when(F.col("n") <= K, (own * 100 <= F.col("n") * (100 - percent)) | ((own + K) * percent <= F.col("n") * 100)).otherwise(own < COLD)
    ends = likely.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("exposed")).union(share.where(few).select("node", F.lit(True).alias("exposed")))
    sets = cut(full_sets(docs, cut(ends.groupBy("node").agg(F.max("exposed").alias("exposed")), ids=True), words))
    found = verified(sets.select("node", "values"), likely, percent)
    return exposed_links(sets.where("exposed").select("node", "values"), found, percent)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    rows = cut(row_sets(docs, words))
    some = rows.where("doc_id is not null and n > 0")
    classes = cut(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    edges = links(docs, classes.select("node", "n", "sketch"), words, percent)
    # rows that share a doc_id but not a set
    label = classes.select("f1", "f2", "node")
    member = some.select("doc_id", "f1", "f2").join(label, ["f1", "f2"])
    torn = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    same = member.join(torn, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    found = components(edges.union(same)).withColumnRenamed("id", "node")
    part = rows.select("doc_id", "n", "f1", "f2").join(cut(label.join(found, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component"))), ["f1", "f2"], "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return part.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group, the one with the smallest doc_id; the columns stay as they are."""
    gone = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


#: DuckDB SQL for near_duplicates(words=4), for a table documents with distinct ids: all pairs that share a shingle, then all that can be reached.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets
), linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), ways AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reached AS (
  SELECT doc_id AS id, doc_id AS other FROM sets UNION SELECT r.id, w.b FROM reached r JOIN ways w ON r.other = w.a
), least AS (
  SELECT id, min(other) AS component_id FROM reached GROUP BY id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = id
"""
