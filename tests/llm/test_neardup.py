import math
import random

import numpy as np

from gristmill.llm import graph, neardup


def brute(rows, words=4, percent=80):
    def shingles(text):
        tokens = (text or "").encode().lower().split()
        return {tuple(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set()

    sets = [shingles(t) for _, t in rows]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    live = [k for k, (d, _) in enumerate(rows) if d is not None and sets[k]]
    for x, i in enumerate(live):
        for j in live[:x]:
            n = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(rows[i][0]), find(rows[j][0])
                up[max(a, b)] = min(a, b)
    return [(d, len(s), d if d is None or not s else find(d)) for (d, _), s in zip(rows, sets)]


def corpus(seed, docs, copies, passage_share):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    rows = []
    for k in range(docs):
        w = [word() for _ in range(rng.choice((2, 5, 40, 80, 200)))]
        if rng.random() < passage_share:
            at = rng.randrange(len(w))
            w[at:at] = passage
        rows.append(w)
        while rng.random() < 0.4:
            w = list(w)
            for _ in range(rng.randrange(1 + len(w) // 15)):
                w[rng.randrange(len(w))] = word()
            rows.append(w)
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(25)):
            w[rng.randrange(len(w))] = word()
        rows.append(w)
    rng.shuffle(rows)
    return [(k, rng.choice((" ", "\n")).join(w).replace("a", "A", 1)) for k, w in enumerate(rows)]


def check(spark, rows):
    df = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, node long").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, words=4).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    return df


def test_equals_brute_force_with_hot_lists(spark):
    """Passages in more documents than a cold list holds, and a large group of near copies on both sides of the limit."""
    rows = corpus(1, 220, 150, 0.5)
    check(spark, rows)


def test_every_way_gives_the_same(spark, monkeypatch):
    """Families of many blocks, families compared list by list, and no broadcast of hot values."""
    rows = corpus(5, 60, 130, 0.6)
    for block, family, hot in ((16, 1 << 16, 1_000_000), (16, 20, 0)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "FAMILY", family)
        monkeypatch.setattr(neardup, "HOT_VALUES", hot)
        check(spark, rows)


def test_common_counts(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(20)]
    want = [[len(set(a.tolist()) & set(b.tolist())) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = neardup.common_counts(sets)
    assert all(got[i, j] == want[i][j] for i in range(20) for j in range(20) if i != j)


def lost(n, common, k=neardup.K):
    """The chance that two sets of n values with so many in common have at most 12 of them among the k smallest of their union."""
    union = 2 * n - common
    ways = lambda c: math.comb(common, c) * math.comb(union - common, k - c)
    return sum(ways(c) for c in range(13)) / math.comb(union, k)


def test_chance_of_a_lost_link():
    """The figure of the description, worked out without rounding for pairs just at the limit: 8 of 10 values of the union are common."""
    for n in (45, 90, 450, 4500, 45000):
        assert lost(n, 8 * (2 * n) // 18) < 3e-7
    assert lost(4600, 8000 * 4600 // 9000 + 200) < 3e-8


def test_odd_rows(spark):
    rows = corpus(2, 12, 6, 0.3)
    rows += [rows[3], (3, rows[9][1]), (None, rows[4][1]), (None, None), (800, None), (801, ""), (802, " \t"), (803, "one two"), (804, "ONE  two"), (805, "one two three"), (806, "x " * 30_000)]
    df = check(spark, rows)
    kept = neardup.keep_first(df, words=4)
    assert kept.columns == df.columns and kept.count() < len(rows)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def longer_variants(seed, shingles, low, high, rank):
    """A text of so many shingles and 36 texts that go on from it: by low shingles whose hashes lie below its value of that rank, then by high others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    base = [word() for _ in range(shingles + 3)]
    below = neardup.shingles(" ".join(base), 4)[rank]
    rows = [base]
    for _ in range(36):
        w = list(base)
        for k in range(low + high):
            while True:
                new = word()
                if (neardup.shingles(" ".join([*w[-3:], new]), 4)[0] < below) == (k < low):
                    break
            w.append(new)
        rows.append(w)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_cold_values_beyond_longer_sketches(spark):
    """A text's largest values fall out of the sketches of its longer variants and so are cold, but common with none of them."""
    for n, low, high, rank in ((32, 8, 0, 24), (100, 17, 8, 14)):
        rows = longer_variants(n, n, low, high, rank)
        assert {c for _, _, c in brute(rows)} == {0}
        check(spark, rows)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, 150 + k) for k in range(40)] + [(500, 400), (400, 500), (7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[150 + k] == 150 for k in range(40)) and got[200] == 150 and got[500] == got[400] == 400
