from linkmill.llm import line_dedup
from linkmill.llm.common import Scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_runs_no_python(spark):
    df = spark.createDataFrame([(0, "some line here\nand more"), (1, "x\nsome line here")], "doc_id long, text string")
    blocks = spark.createDataFrame([(0, 0, 1)], "id long, at long, more int")
    with Scratch(spark) as work:
        plans = plan(line_dedup.fingerprints(df, 2, 3, 50, 10)), plan(line_dedup.later_passages(df, blocks, 50, work)), plan(line_dedup.line_dedup(df))
    assert not [p for p in plans if "Arrow" in p or "Python" in p]


def test_every_passage_is_in_one_block(spark):
    texts = ["w " * 130, " ".join(f"w{i}" for i in range(3_000)), " ".join("one two three"[: i % 13 + 1] for i in range(700)), "w " * 49, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in line_dedup.fingerprints(df, 2, 3, 50, 10).filter("span > 0").collect():
        assert r.span >> 8 == (r.span & 255) + 50
        got.setdefault(r.id, []).extend(range(r.start, r.start + (r.span & 255) + 1))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == list(range(len(t.split()) - 49)), i
