"""Graph documents are judged where they are: what is dealt by graph stays there, and documents of one graph count as one."""

from millrace.operators import graphdoc


def test_integrity_of_documents_dealt_by_graph_shuffles_nothing(spark):
    text = '{"places":[{"id":"p"},null,{"id":"p"}],"stops":[{"id":"1","place":"x"}],"patterns":[{"id":"a","stops":["1","2","2"]},{"id":"a","stops":["2"]}]}'
    rows = spark.createDataFrame([(1, text), (1, '{"places":[{"id":"x"},{"id":"p"}],"stops":[{"id":"3","place":""}]}'), (None, "[]"), (None, '{"stops":[{"id":"2","place":"p"}]}')], "k int, t string")
    found = graphdoc.integrity(graphdoc.parsed(rows.repartition(4, "k"), "k", "t"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [
        (1, "places", "p", "id", None, "repeated"), (1, "places", None, "id", None, "unnamed"), (1, "patterns", "a", "id", None, "repeated"), (1, "stops", "3", "place", "", "orphan"),
        (1, "patterns", "a", "stops", "2", "orphan"), (1, "patterns", "a", "stops", "2", "orphan"), (None, "stops", "2", "place", "p", "orphan"), (None, None, None, None, None, "unread"),
    ]))
