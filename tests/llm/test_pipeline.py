import corpus_pipeline
from quillflow.llm import super_minhash
from tests.llm import brute
from tests.llm.test_operators import RANKS, corpus, encoding, prose


def test_stages(spark, tmp_path):
    texts = corpus() | {200: prose(90), 300: corpus()[106] + " more", 301: corpus()[3], 302: "one two"}
    leak = " ".join(brute.leak_words(texts[200])[20:45])
    rows = [(i, t, "en", "s", len(t or ""), i, "x") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, docs, seen = f"file://{tmp_path}", spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        assert name == "byte_bpe" or out.columns == columns
        out.write.parquet(f"{d}/stage-{k}")
        docs = spark.read.parquet(f"{d}/stage-{k}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["quality_rules"]) == {i for i, t in texts.items() if not brute.quality(t)[5]}
    before = {i: r["text"] for i, r in seen["line_dedup"].items()}
    whole = {i: c for i, (_, c) in brute.groups({i: texts[i] for i in before}).items()}
    left = {i for i, c in whole.items() if c == i}
    groups = brute.groups({i: before[i] for i in left})
    assert set(seen["near_dedup"]) == {i for i, (_, c) in groups.items() if c == i}
    assert len(before) > len(left) > 10  # near copies of which line dedup leaves remnants
    after = {i: r["text"] for i, r in seen["decontaminate"].items()}
    assert set(after) == set(seen["near_dedup"]) and brute.leaks({0: after[200]}, [(1, leak)])[0][1] == set()
    assert all(after[i] == before[i] for i in after if not brute.leaks({0: before[i]}, [(1, leak)])[0][1])
    assert {i: list(r["ids"]) for i, r in seen["byte_bpe"].items()} == {i: encoding().encode_ordinary(t) for i, t in after.items()}
    whole = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == {i: list(r["ids"]) for i, r in seen["byte_bpe"].items()} and RANKS


def test_empty_tables_and_repeated_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = prose(120)
    for name, rows, left in (("none", [], []), ("some", [(5, text), (5, text), (None, text), (None, None), (6, "")], [5, 5, None])):
        d = f"file://{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        # Equal rows of one id are one document; a row without an id links with nothing, and line dedup leaves its short lines.
        assert sorted(r["doc_id"] or 0 for r in got) == sorted(i or 0 for i in left), name


def test_repeated_ids_of_different_texts(spark, tmp_path):
    """Each row stays or goes, and gets its group, by its own text."""
    a, b = prose(60), prose(60)
    rows = [(1, a), (7, a), (7, b), (7, None), (9, b), (9, prose(60))]
    df = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id bigint, text string, version string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.near_dedup(spark, df, f"file://{tmp_path}")
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == sorted([(1, a), (7, b), (7, ""), rows[5]])
    found = [(r.doc_id, r.component_id) for r in super_minhash.near_duplicates(df).collect()]
    assert sorted(found) == [(1, 1), (7, 1), (7, 7), (7, 7), (9, 7), (9, 9)]
