import corpus_pipeline

PASSAGE = "\n".join(f"line {i} of the passage that all sites carry" for i in range(6))


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or "")) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long")


def test_copies_on_many_sources_leave_no_empty_rows(spark, folder, monkeypatch):
    own = [(i, " ".join(f"own{i}x{k}" for k in range(30)), f"s{i % 5}") for i in range(40)]
    copies = [(100 + i, PASSAGE, f"s{i % 3}") for i in range(12)]
    documents(spark, own + copies + [(300, "", "s1")]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 3)) for i in range(40)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[:-1] + [
        ("rows", lambda spark, docs, folder: docs)])
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i for i in got if i >= 100} == {100, 300}
    assert got[100] == PASSAGE and got[300] == ""


def test_equal_rows_and_null_ids_are_copies(spark, folder):
    text = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"other{k}" for k in range(40))
    docs = documents(spark, [(7, text, "a"), (7, text, "a"), (None, text, "b"), (9, text + " end", "c"),
                             (None, other, "a"), (None, other, "a"), (5, "", "a"), (5, "", "a"),
                             (6, "", "a"), (None, "", "a"), (8, None, "a")])
    out = corpus_pipeline.near_duplicate_stage(spark, docs, folder).collect()
    assert sorted(((r["doc_id"] or 0, r["text"] or "-") for r in out)) == sorted(
        [(7, text), (0, other), (5, "-"), (6, "-"), (0, "-"), (8, "-")])
