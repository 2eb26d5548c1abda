import random

from gristmill.llm import mixing


def targets(sizes):
    """Clamp and share again until nobody is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    wanted, clamped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in clamped]
        rest = wanted - sum(2 * sizes[s] for s in clamped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            return share | {s: 2 * sizes[s] for s in clamped}
        clamped |= over


def test_equals_the_rule(spark):
    rng = random.Random(3)
    names = ["a", "B", "é", "z", "", None, "zz", "😀", "￿"]
    rows = [(k, " \n".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(40))), names[min(rng.randrange(12), 8)]) for k in range(400)] + [(7, None, "a"), (None, "x y", "only"), (7, "", "none")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_words(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    assert len(got) == len(rows)
    joined = df.select("doc_id", "source").distinct().collect()
    of = {r.doc_id: r.source for r in joined if r.doc_id not in (7, None)}
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id in of:
            s = of[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
            taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in taken)  # the rows of id 7 and None are left out here
    parts = [r for r in got if r.doc_id in of and r.size and r.taken % r.size]
    assert len(parts) <= len(names)  # whole repetitions but for one document a source
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_words(df.repartition(3)).collect()), key=str)
    assert mixing.mix_words(df.limit(0)).count() == 0


def test_documents(spark):
    rows = [(k, "w " * 20, ("big", "small", "tiny")[0 if k < 700 else 1 if k < 950 else 2], "x") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epochs string")
    mixed = mixing.mix_documents(df)
    words = {r.doc_id: r.taken for r in mixing.mix_words(df).collect()}
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(abs(20 * times.get(d, 0) - t) <= 10 for d, t in words.items())
    assert mixed.columns == df.columns
    want = targets({"big": 14000, "small": 5000, "tiny": 1000})
    for r in mixed.groupBy("source").count().collect():
        assert abs(20 * r["count"] - want[r.source]) <= 20
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0


def test_repeated_rows_and_long_texts(spark):
    """Equal rows, rows without id and one long text: each source still meets its target, and nothing is taken more than twice."""
    rows = [(None, "w " * 7, "a")] * 300 + [(5, "w " * 3, "b")] * 200 + [(6, "w " * 40_000, "c")] + [(k, None, "d") for k in range(5)] + [(k, "w " * (k % 9), "a") for k in range(100)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, place string")
    got = mixing.mix_words(df).collect()
    sizes, taken = {"a": 300 * 7 + sum(k % 9 for k in range(100)), "b": 600, "c": 40_000, "d": 0}, {}
    of = {v: k for k, v in sizes.items()}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[of[r.source_size]] = taken.get(of[r.source_size], 0) + r.taken
    want = targets(sizes)
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 150 for s in sizes)
    assert mixing.mix_documents(df).columns == df.columns
