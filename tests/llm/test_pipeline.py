import corpus_pipeline
from test_linededup import brute as brute_lines
from test_neardup import brute as brute_near

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
        assert k == 4 or docs.columns == columns
    raw, named, lined, single, mixed, packed = seen
    assert len(named) >= 0.99 * len(raw) and {r.text for r in named} <= {r.text for r in raw}
    want = {d: t for d, _, _, _, t in brute_lines([(r.doc_id, r.text) for r in named])}
    assert {r.doc_id: r.text for r in lined} == want and all(r.n_chars == len(r.text) for r in lined)
    groups = brute_near([(r.doc_id, r.text) for r in lined], words=5)
    assert {r.doc_id for r in single} == {d for d, _, c in groups if d == c}
    texts = {r.doc_id: r.text for r in single}
    assert all(texts[r.doc_id] == r.text for r in mixed)
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(mixed) - 1.5 * words(single)) < 0.25 * words(single)
    assert sorted(r.doc_id for r in packed) == sorted(r.doc_id for r in mixed) and sum(r.length for r in packed) == words(mixed)
    assert len({(r.bucket, r.batch, r.slot) for r in packed}) == len(packed)


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, size long, place string, row int, of string, lost string, node long, v long, epochs string, whole int, more int, bound int, length long, target double, hi long, rank int"


def test_run_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and columns that stages use as names of their own; then no rows at all."""
    source = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in source]
    rows += [rows[0], rows[0], (None, rows[1][1], "en", "web", 3), (None, None, None, None, None), (900, None, "en", None, None), (901, "", None, "web", 0), (902, "the cat and the dog " * 30_000, "en", "", 600_000), (903, rows[2][1], None, None, None)]
    df = spark.createDataFrame([(*r, *[k % 3 if t != "string" else f"x{k % 3}" for t in ("long", "string", "int", "string", "string", "long", "long", "string", "int", "int", "int", "long")], 0.5, 7, k) for k, r in enumerate(rows)], CLASHES)
    df.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    docs = df
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == df.columns and docs.dtypes == df.dtypes
    want = docs.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in want) and len(got) >= 60
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got) and {r.doc_id for r in got} & {900, 901} == set()
    assert {"place", "hi", "bound"} <= set(docs.columns) and all(r.rank is not None and r.hi == 7 for r in want)
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
