import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_in_order_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, None
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= before and len(kept) > 0.5 * len(before)
    pieces = corpus_pipeline.pack(spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == kept
    assert docs.where("n_chars <> char_length(text)").count() == 0


@pytest.fixture
def odd(spark, tmp_path):
    """Tables with nulls, empty and repeated rows, ids that repeat with other texts, and columns with clashing names."""
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word59", "other")
    rows = [(1, base), (2, near), (2, "a text of its own that nothing else is like " * 3), (3, base), (3, base), (4, None), (5, ""), (None, "no id " * 9), (None, None), (6, "call 743-555-3824 " + "x" * 50_000), (7, base + " z"), (7, near)]
    wide = [(i, t, "en", "s", 1, 0.9, 5, True, 7, "k") for i, t in rows]
    spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, _score double, text_key long, kept boolean, item_id long, `_key` string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "what is asked here today. the answer is given so."), (2, None), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_on_odd_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, odd)
        assert got.columns == docs.columns and got.count() <= docs.count(), name
        assert stage(spark, docs.where("false"), odd).count() == 0, name
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, odd).collect()
    # one of the group of 1, 2, 3, 7; the other text of id 2 stays, as do texts that nothing is like
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:7]) for r in kept) == sorted([(1, "word0 w"), (2, "a text "), (4, ""), (5, ""), (0, "no id n"), (0, ""), (6, "call 74")])
    private = {r["doc_id"]: r for r in corpus_pipeline.replace_pii(spark, docs, odd).collect()}
    assert "743-555-3824" not in private[6]["text"] and private[6]["n_chars"] == len(private[6]["text"]) and private[6]["_key"] == "k"
    assert corpus_pipeline.run(spark, odd).count() > 0
