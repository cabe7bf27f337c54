"""The quality stage of the pipeline."""

from pyspark.sql import functions as F

from linkmill.llm import quality


def test_rows_pass_through_arrow_batches_with_every_column(spark):
    docs = spark.createDataFrame([("a", i, "good words in a sentence." if i % 2 else "|| || !!! 77 ||", i * 1.5) for i in range(60)] + [("z", None, None, None)], "source string, doc_id long, text string, more double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for threshold in (0.5, 0.0):
        got = quality.keep_good(docs, labels, threshold)
        plan = got._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and got.columns == docs.columns
        good = {r.doc_id for r in quality.score_documents(docs, quality.fit(docs, labels)).filter(F.col("score") >= threshold).collect()}
        want = [tuple(r) for r in docs.collect() if r.doc_id in good]
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
        assert want and (threshold == 0.0) == (len(want) == 61)
