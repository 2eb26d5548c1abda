import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gristmill.llm import media


def test_gear_equals_a_byte_loop():
    data = random.Random(1).randbytes(5000)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert media.gear(data).tolist() == want


def test_cuts_bounds_and_shift():
    data = random.Random(2).randbytes(700_000)
    ends = media.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(media.MIN_CHUNK <= n <= media.MAX_CHUNK for n in sizes[:-1]) and len(ends) > 10
    shifted = {hashlib.sha256(c).digest() for c in media.chunks_of(b"abc" + data)}
    assert sum(hashlib.sha256(c).digest() in shifted for c in media.chunks_of(data)) > len(ends) - 5
    assert media.cuts(b"") == [0] and media.cuts(b"x" * 300_000)[-1] == 300_000


def want(text):
    raw = (text or "").encode()
    data = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])


def test_rows_and_store(spark, tmp_path):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdé fghij\n") for _ in range(150_000))
    texts = [None, "", "a", "a", "x" * 576, long, long + "tail", long]
    df = spark.createDataFrame([(k if k else None, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = media.media_columns(df).collect()
    assert sorted(((r.doc_id or 0), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((k, *want(t)) for k, t in enumerate(texts))
    by = {r.doc_id or 0: r for r in got}
    assert by[5].media_sha256 == by[7].media_sha256 and by[5].feature == by[7].feature and by[5].n_chunks > 2
    assert media.media_columns(df.limit(0)).count() == 0
    path = str(tmp_path / "store")
    media.write_store(df.where("doc_id < 6 or doc_id is null"), path)
    media.write_store(df.where("doc_id >= 6"), path)
    refs, store = media.read_store(spark, path)
    assert store.count() == store.select("digest").distinct().count()
    assert store.agg({"length": "sum"}).first()[0] < 1.5 * len(long.encode())
    assert {r.doc_id or 0: bytes(r.payload[: r.n_bytes]).decode() for r in media.payloads(refs, store).collect()} == {k: t or "" for k, t in enumerate(texts)}
    for gone in (store.where("length < 600"), store.where("length > 600")):
        with pytest.raises(Exception, match="not in the store"):
            media.describe(refs, gone).collect()
    spoilt = store.withColumn("length", store.length + 1).withColumn("frame", F.substring("frame", 1, 40))
    with pytest.raises(Exception):
        media.describe(refs, spoilt).collect()


def test_chunks_are_stored_once(spark, tmp_path):
    """Equal chunks of many rows and of earlier writes, whichever way they take."""
    rng = random.Random(4)
    part = ["".join(rng.choice("abcdefgh ") for _ in range(9000)) for _ in range(5)]
    rows = [(k, "".join(rng.sample(part, 3)) if k % 3 else f"text {k % 4}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = str(tmp_path / "store")
    for k in range(2):
        media.write_store(df.where(f"doc_id % 2 = {k}"), path)
    refs, store = media.read_store(spark, path)
    want = {hashlib.sha256(c).digest() for _, t in rows for c in media.chunks_of(media.payload_of(t)[0])}
    assert sorted(bytes(r.digest) for r in store.collect()) == sorted(want) and refs.count() == 60
    got = {r.doc_id: r.payload_sha256 for r in media.describe(refs, store).collect()}
    assert got == {k: hashlib.sha256(media.payload_of(t)[0]).hexdigest() for k, t in rows}
