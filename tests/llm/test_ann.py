import math

import numpy as np

from gristmill.llm import ann


def brute(rows, every, top):
    live = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            live[i] = np.array(v, float)
    ids = sorted(live)
    m = np.array([live[i] / np.sqrt(live[i] @ live[i]) for i in ids])
    out = {}
    for q in ids:
        if q % every == 0:
            s = m @ m[ids.index(q)]
            out[q] = [x for _, x in sorted((-round(float(s[k]), 12), x) for k, x in enumerate(ids) if x != q)[:top]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    rows = [(k, (centres[k % 30] + 0.4 * rng.normal(size=24)).astype(float).tolist()) for k in range(3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = ann.nearest(df, shard=1000).collect()
    want = brute(rows, 50, 5)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
        a, b = np.array(rows[r.query_id][1]), np.array(rows[r.vec_id][1])
        assert abs(r.score - a @ b / math.sqrt((a @ a) * (b @ b))) < 1e-12
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)


def test_odd_rows(spark):
    same = [1.0, 2.0]
    rows = [(k, same) for k in range(40)] + [(100, [2.0, 1.0]), (150, None), (200, [0.0, 0.0]), (250, [1.0, float("nan")]), (300, [None, 1.0]), (350, [float("inf"), 1.0]), (None, same), (0, same), (400, [1e200, 1e199]), (450, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {0, 100, 400, 450}
    assert got[0] == [(k, k) for k in range(1, 6)] and [x for _, x in got[100]] == [400, 450, 0, 1, 2]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id = 100")).count() == 0
    assert ann.nearest(df.where("vec_id in (3, 100)")).count() == 1


def test_lengths_are_apart_and_batches_small(spark):
    """Vectors of other lengths are no candidates; queries pass by a graph in many Arrow batches."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=(3, 5, 8)[k % 3]).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {}
    for w in (3, 5, 8):
        want |= brute([r for r in rows if len(r[1]) == w], 10, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {}
        for r in sorted(ann.nearest(df, every=10, shard=100).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r.vec_id)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want) and sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.98 * 5 * len(want)
    assert all(len(rows[x][1]) == len(rows[q][1]) for q, found in got.items() for x in found)
