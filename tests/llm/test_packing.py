import itertools
import random

import numpy as np

from gristmill.llm import packing


def test_boundaries_are_optimal():
    rng = random.Random(8)
    for _ in range(150):
        largest = np.array(sorted(rng.sample(range(1, 60), rng.randrange(1, 8))))
        counts = np.array([rng.randrange(1, 9) for _ in largest])
        buckets = rng.randrange(1, 5)
        cost = lambda tops: sum(int(c) * min(t for t in tops if t >= x) for x, c in zip(largest, counts))
        got = packing.boundaries(largest, counts, buckets)
        best = min(cost([*some, largest[-1]]) for k in range(min(buckets, len(largest))) for some in itertools.combinations(largest[:-1].tolist(), k))
        assert got == sorted(set(got)) and len(got) <= buckets and cost(got) == best
    assert packing.boundaries(np.array([]), np.array([]), 3) == []


def test_boundaries_of_many_lengths():
    """Against the plain recurrence, beyond what combinations allow; and many different lengths in seconds."""
    rng = random.Random(3)
    largest = np.array(sorted(rng.sample(range(1, 50_000), 300)))
    counts = np.array([rng.randrange(1, 10**9) for _ in largest])
    best = [int(largest[j]) * int(counts[: j + 1].sum()) for j in range(300)]
    for _ in range(11):
        best = [min([best[j], *(best[i] + int(largest[j]) * int(counts[i + 1 : j + 1].sum()) for i in range(j))]) for j in range(300)]
    tops = packing.boundaries(largest, counts, 12)
    assert len(tops) == 12 and sum(int(c) * min(t for t in tops if t >= x) for x, c in zip(largest, counts)) == best[-1]
    assert len(packing.boundaries(np.arange(1, 100_001), np.ones(100_000, np.int64), 12)) == 12


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    rng = random.Random(9)
    rows = [(k, "w " * rng.choice((0, 1, 3, 10, 50, 51, 300, 2500, 2600))) for k in range(300)] + [(3, None), (None, "w"), (None, "w"), (5, "w " * 9000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    got = packing.pack(df, buckets=4, budget=1000).collect()
    assert len(got) == len(rows) and sorted((str(r.doc_id), r.length) for r in got) == sorted((str(d), (t or "").count("w")) for d, t in rows)
    batches = {}
    for r in got:
        assert r.length <= r.bucket_length and r.padding == r.bucket_length - r.length
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        fit = max(1, 1000 // max(1, members[0].bucket_length))
        assert sorted(r.slot for r in members) == list(range(len(members))) and (len(members) == fit or (bucket, batch + 1) not in batches)
    assert packing.pack(df.limit(0)).count() == 0


def test_equal_rows_fall_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    df = spark.createDataFrame([(None, "w " * 10, "x")] * 2000 + [(k, "w", "y") for k in range(10)], "doc_id long, text string, draw string")
    got = packing.pack(df, buckets=2, budget=100).collect()
    many = sorted((r.batch, r.slot) for r in got if r.doc_id is None)
    assert many == [(k // 10, k % 10) for k in range(2000)] and len(got) == 2010
