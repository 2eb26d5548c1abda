"""Media columns by content-defined chunking: gear-hash cuts, chunks kept once by digest, and ordered chunk lists.

A text's payload is its UTF-8 bytes, filled with bytes 255 up to a positive multiple of 576. A rolling gear hash over the payload
chooses the cuts, so equal stretches in different payloads give equal chunks. A media is stored as a recipe (length and ordered chunk digests)
and its chunks, each a compressed frame of 8-bit samples under its SHA-256. Recipes and chunks are Parquet tables in a folder that the cluster shares. Reading back
opens those files, joins recipes to chunks, tests every chunk and the whole payload against their digests, and fails on any difference or gap.

Equal chunks are stored once. Only chunks that may be repeated are shuffled: digests are counted first, and a chunk whose digest shares no slot with a repeated one
is written where it was cut. A media of one chunk has its chunk's digest, so it is read back where the chunk lies; only the parts of longer media are gathered.
Equal payloads are one media, read back once, whatever the number of documents that hold them. Nulls: a null
text is the empty text (576 bytes of 255); a null doc_id stays null. Repeated rows each give their row. Payloads are never cut short:
MAX_CHUNK bounds a chunk, not a media. One media is assembled in one task's memory, as one text is. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ID_SLOTS, exists, maybe_in, number_of_partitions, own_folder, remove, row_map

UNIT = 576
MIN_CHUNK, MAX_CHUNK = 2048, 32768
#: A cut has MASK's bits of its hash zero: on average every 8 KB beyond MIN_CHUNK.
MASK = 0x1FFF0000
WINDOW = 32
LEVEL = 6
#: Digests that a task remembers.
SEEN = 50_000
GEAR = np.random.default_rng(576).integers(0, 1 << 32, 256, dtype=np.uint32)


RECIPES = "doc_id long, n_bytes long, media binary, digests array<binary>"
CHUNKS = "digest binary, length int, frame binary, home binary"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT), len(raw)


def gear(data: bytes) -> np.ndarray:
    """The gear hash after each byte: the sum of GEAR of the last 32 bytes, each shifted left by its age. Doubling needs five steps."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def cuts(data: bytes, least: int = MIN_CHUNK, most: int = MAX_CHUNK, mask: int = MASK) -> list[int]:
    """Ends of the chunks of data, in order; the last is its length."""
    n = len(data)
    if n <= least:
        return [n]
    places = np.flatnonzero((gear(data) & np.uint32(mask)) == 0) + 1
    ends, at, k = [], 0, 0
    while n - at > least:
        k += int(np.searchsorted(places[k:], at + least))
        end = min(n, at + most)
        if k < len(places) and places[k] < end:
            end = int(places[k])
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes) -> Iterator[bytes]:
    at = 0
    for end in cuts(data):
        yield data[at:end]
        at = end


def features(data: bytes) -> str:
    """Mean, deviation and entropy of the samples, and their share in each quarter of the range."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts / len(data)
    mean = float(p @ np.arange(256))
    spread = float(np.sqrt(max(0.0, p @ (np.arange(256) - mean) ** 2)))
    some = p[p > 0]
    quarters = ",".join(f"{x:.6f}" for x in p.reshape(4, 64).sum(1))
    return f"mean={mean:.6f};std={spread:.6f};entropy={max(0.0, float(-(some * np.log2(some)).sum())):.6f};quarters={quarters}"


def recipe_of(n_bytes: int, digests: list[bytes], lengths: list[int]) -> bytes:
    return b"GCM1" + struct.pack("<QI", n_bytes, len(digests)) + b"".join(struct.pack("<I", n) + d for d, n in zip(digests, lengths, strict=True))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (SHA-256 of the payload), digests (the ordered list) for every row; narrow."""

    def rows(given: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text in given:
            data, n = payload_of(text)
            yield doc_id, n, hashlib.sha256(data).digest(), [hashlib.sha256(c).digest() for c in chunks_of(data)]

    return row_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, RECIPES)


def chunk_rows(docs: DataFrame, marked: np.ndarray | None = None, wanted: bool = True) -> DataFrame:
    """digest, length, frame, home of the chunks of every row whose digest's slot is marked (or, if not wanted, isn't); of all without marks. Narrow. A task gives a chunk
    at most once in a run of SEEN others. marked has ID_SLOTS truth values. home: the longer media that alone has the chunk, where that is sure; else null."""
    shared = None if marked is None else docs.sparkSession.sparkContext.broadcast(np.packbits(marked))
    slots = ID_SLOTS

    def rows(given: Iterator[tuple]) -> Iterable[tuple]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        bits = None if shared is None else np.unpackbits(shared.value).astype(bool)
        seen: dict[bytes, None] = {}
        for (text,) in given:
            data = payload_of(text)[0]
            pieces = list(chunks_of(data))
            home = hashlib.sha256(data).digest() if len(pieces) > 1 and not wanted else None
            for c in pieces:
                digest = hashlib.sha256(c).digest()
                if digest in seen or bits is not None and bits[int.from_bytes(digest[:3], "big") % slots] != wanted:
                    continue
                seen[digest] = None
                if len(seen) > SEEN:
                    del seen[next(iter(seen))]
                yield digest, len(c), pack.compress(c), home

    return row_map(docs.select("text"), rows, CHUNKS)


def distinct_chunks(rows: DataFrame) -> DataFrame:
    """Each chunk once. Equal ones meet within a task before the shuffle, so a hot chunk costs a row a task."""
    return rows.groupBy("digest").agg(F.first("length").alias("length"), F.first("frame").alias("frame"), F.lit(None).cast("binary").alias("home"))


def marks(*digests: DataFrame) -> np.ndarray:
    """Which of ID_SLOTS slots hold one of these digests: at most so many numbers reach the driver."""
    slot = (F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int") % ID_SLOTS).alias("slot")
    out = np.zeros(ID_SLOTS, bool)
    for found in digests:
        out[found.select(slot).distinct().toArrow().column("slot").to_numpy()] = True
    return out


def distinct_media(refs: DataFrame) -> DataFrame:
    return refs.groupBy("media").agg(F.first("n_bytes").alias("n_bytes"), F.first("digests").alias("digests"))


def gathered(refs: DataFrame, store: DataFrame) -> DataFrame:
    """media, digests, parts of each distinct media of refs that has several chunks. Chunks that have a home go there at once; only the others are first looked up by digest."""
    longer = distinct_media(refs.where(F.size("digests") > 1)).select("media", "digests")
    place = longer.select("media", F.explode("digests").alias("digest")).distinct()
    homed = store.where("home is not null")
    elsewhere = place.join(homed.select(F.col("home").alias("media"), "digest"), ["media", "digest"], "left_anti")
    columns = ["media", F.struct("digest", "length", "frame").alias("part")]
    found = elsewhere.join(maybe_in(store.drop("home"), elsewhere, "digest"), "digest").select(*columns).union(homed.withColumnRenamed("home", "media").select(*columns))
    return longer.join(found.groupBy("media").agg(F.collect_list("part").alias("parts")), "media")


def read_back(refs: DataFrame, store: DataFrame) -> DataFrame:
    """media, payload_bytes, tail_crc32, media_bytes, stored (digest of the stored form), feature, n_chunks of each distinct media of refs, from stored chunks alone, their digests verified. Chunks
    that are only parts of media give rows under their own digests, too, which meet no recipe."""
    single = store.select(F.col("digest").alias("media"), F.array("digest").alias("digests"), F.array(F.struct("digest", "length", "frame")).alias("parts"))
    return row_map(single.union(gathered(refs, store)), verified, READ_SCHEMA)


READ_SCHEMA = "media binary, payload_bytes long, tail_crc32 long, media_bytes long, stored binary, feature string, n_chunks int"


def assemble(media: bytes, digests: list[bytes], parts: list[dict]) -> tuple[bytes, list[dict]]:
    """(the payload, its parts in order), after chunks and payload are tested against their digests."""
    unpack = zstandard.ZstdDecompressor()
    by = {p["digest"]: p for p in parts}
    pieces = []
    for k, digest in enumerate(digests):
        if digest not in by:
            raise ValueError(f"not in the store: chunk {k} of media {media.hex()}")
        piece = unpack.decompress(by[digest]["frame"], max_output_size=by[digest]["length"])
        if hashlib.sha256(piece).digest() != digest:
            raise ValueError(f"chunk {k} of media {media.hex()} was damaged")
        pieces.append(piece)
    data = b"".join(pieces)
    if hashlib.sha256(data).digest() != media:
        raise ValueError(f"media {media.hex()} was damaged")
    return data, [by[d] for d in digests]


def verified(given: Iterator[tuple]) -> Iterable[tuple]:
    for media, digests, found in given:
        data, parts = assemble(media, digests, found)
        # UTF-8 has no byte 255, so what isn't filling is the text
        stored = recipe_of(len(data.rstrip(b"\xff")), digests, [p["length"] for p in parts])
        whole = hashlib.sha256(stored)
        for p in parts:
            whole.update(p["frame"])
        yield media, len(data), zlib.crc32(data[-32:]), len(stored) + sum(len(p["frame"]) for p in parts), whole.digest(), features(data), len(parts)


def describe(refs: DataFrame, store: DataFrame) -> DataFrame:
    """doc_id and what read_back() gives, for every row of refs. The many rows of a hot media are joined to its one row last, without payloads. The payload's digest is the
    media's name, which read_back() has verified."""
    found = refs.select("doc_id", "n_bytes", "media").join(read_back(refs, store), "media", "left")
    missing = F.raise_error(F.concat(F.lit("not in the store: media "), F.hex("media")))
    shown = lambda c: F.lower(F.hex(c))
    return found.select(
        "doc_id", "n_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(missing.cast("long")).alias("payload_bytes"), shown("media").alias("payload_sha256"), "tail_crc32",
        "media_bytes", shown("stored").alias("media_sha256"), "feature", "n_chunks",
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """The columns of every document's media, written to a store of this query's own and read from its files."""
    spark = docs.sparkSession
    path = own_folder(spark, "media")
    write_store(docs, path)
    return describe(*read_store(spark, path))


def write_store(docs: DataFrame, path: str) -> None:
    """Adds docs to the store under path: recipes, and the chunks that it does not hold yet. Both are Parquet, and are read by read_store()."""
    spark = docs.sparkSession
    new = f"{path}/recipes-{uuid.uuid4().hex}"
    recipes(docs).write.parquet(new)
    digests = spark.read.parquet(new).select("media", F.explode("digests").alias("digest"))
    often = [digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")]
    old = spark.read.parquet(f"{path}/chunks").select("digest") if exists(spark, f"{path}/chunks") else None
    marked = marks(*often, *([old] if old is not None else []))
    maybe = distinct_chunks(chunk_rows(docs, marked, True))
    if old is not None:
        maybe = maybe.join(old, "digest", "left_anti")
    maybe.write.parquet(f"{path}/new")  # apart, as it reads what it will be added to
    chunk_rows(docs, marked, False).write.mode("append").parquet(f"{path}/chunks")
    spark.read.parquet(f"{path}/new").coalesce(max(1, number_of_partitions(spark) // 4)).write.mode("append").parquet(f"{path}/chunks")
    remove(spark, f"{path}/new")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(recipes, chunk store) under path."""
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes-*"), spark.read.schema(CHUNKS).parquet(f"{path}/chunks")


def payloads(refs: DataFrame, store: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload of every row of refs."""
    single = store.select(F.col("digest").alias("media"), F.array("digest").alias("digests"), F.array(F.struct("digest", "length", "frame")).alias("parts"))

    def rows(given: Iterator[tuple]) -> Iterable[tuple]:
        for media, digests, found in given:
            yield media, assemble(media, digests, found)[0]

    return refs.select("doc_id", "n_bytes", "media").join(row_map(single.union(gathered(refs, store)), rows, "media binary, payload binary"), "media").drop("media")


#: DuckDB SQL for the payload columns of media_columns(), for a table documents.
SQL = r"""
WITH sized AS (
  SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents
), filled AS (
  SELECT doc_id, octet_length(raw) AS n_bytes, raw || repeat('\xFF'::BLOB, greatest(1, (octet_length(raw) + 575) // 576) * 576 - octet_length(raw)) AS payload FROM sized
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256 FROM filled
"""
