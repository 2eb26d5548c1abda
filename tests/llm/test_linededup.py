import hashlib
import random

from gristmill.llm import linededup

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows):
    holders = {}
    for d, t in rows:
        if d is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                if len(k) >= 20:
                    holders.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not (len(h := holders.get(key(x), ())) >= 3 and d < max(h))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def cases():
    rng = random.Random(2)
    pool = [f"{'ÉLine' if k % 2 else 'line'} number {k} " + "abc " * 4 for k in range(30)] + ["short", "", "  \t", "x" * 20, "é" * 19, "é" * 20]
    rows = [(d, "\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", " \r"]) for x in rng.choices(pool, k=rng.randrange(9)))) for d in range(80)]
    return [*rows, rows[5], (7, "x" * 20), (None, "x" * 20), (None, None), (90, None), (91, ""), (92, ("x" * 20 + "\n") * 5000)]


def test_equals_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(d, t, d, "k") for d, t in rows], "doc_id long, text string, last long, hi string")
    want = sorted(brute(rows), key=str)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.line_report(df).collect()), key=str)
    assert got == [x[:4] for x in want]
    kept = linededup.drop_lines(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted(((x[0], x[4]) for x in want), key=str)
    assert linededup.line_report(df.limit(0)).count() == 0


def test_runs_do_not_depend_on_batches(spark, tmp_path):
    df = spark.createDataFrame(cases(), "doc_id long, text string")
    keys = linededup.line_keys(df).cache()
    found = []
    for batches, fanout in ((1, 2), (5, 2), (7, 3)):
        runs = linededup.LineRuns(spark, str(tmp_path / f"{batches}"), fanout)
        for k in range(batches):
            runs.add(keys.where(f"doc_id % {batches} = {k}"))
        assert all(len(level) < fanout for level in runs.levels)
        found.append(sorted(map(tuple, runs.repeated().collect())))
        runs.drop()
        assert not spark.catalog.listTables(pattern="line_runs_*")
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
