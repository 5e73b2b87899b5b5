"""Documents that line dedup leaves without a word leave the pipeline."""

import corpus_pipeline


def test_copies_leave_once_their_lines_are_gone(spark, tmp_path):
    text = "\n".join(f"line number {i} of the copied text {i * i}" for i in range(12))
    rows = [(1, text), (2, text), (3, text + "\n\n"), (4, ""), (5, None), (6, " \n"), (7, "another text that nothing else here is like"), (8, text), (8, text), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_duplicates):
        docs = stage(spark, docs, str(tmp_path)).cache()
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 4, 5, 6, 7]
