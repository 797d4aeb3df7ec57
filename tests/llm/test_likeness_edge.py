import random

from lumenweave.llm import simhash


def test_texts_below_the_edge_stay(spark):
    """Pairs of 0.70 to 0.79 by scattered edits, of which no chain may drop one."""
    r = random.Random(3)
    texts = []
    for _ in range(60):
        a = [f"w{r.randrange(2000)}" for _ in range(300)]
        b = list(a)
        for i in range(0, 300, 300 // 9):
            b[i] = "edited"
        sets = [{tuple(x[i : i + 5]) for i in range(296)} for x in (a, b)]
        if 0.7 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8:
            texts += [a, b]
    assert len(texts) > 80
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    assert simhash.one_of_each(docs).count() == len(texts)


def test_least_of_repeated_rows_stays(spark):
    schema = "own_hash string, doc_id long, text string, `a.b` int, tags map<string,int>, x string"
    same = " ".join(f"w{i}" for i in range(40))
    rows = [("h", 1, same, 2, {"k": 1}, "later"), ("h", 1, same, 1, {"k": 2}, "b"), ("h", 1, same, 1, {"k": 1}, "z"), ("h", 1, same, 1, {"k": 1}, "y"), ("g", 2, same, 0, None, None)]
    empty = [("h", 3, None, 5, None, None), ("h", 3, "", 5, None, "e"), ("h", None, same + " more of other words that follow on here", 9, None, "n")]
    for order in (1, -1):
        docs = spark.createDataFrame((rows + empty)[::order], schema)
        got = simhash.one_of_each(docs)
        assert got.columns == docs.columns
        assert {(r.own_hash, r.doc_id, r.text, r["a.b"], str(r.tags), r.x) for r in got.collect() if r.doc_id is not None} == {("h", 1, same, 1, "{'k': 1}", "y"), ("h", 3, "", 5, "None", "e")}
    assert simhash.one_of_each(spark.createDataFrame([], schema)).count() == 0
