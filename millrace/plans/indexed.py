"""A maintained index over documents: increments, and web-style search with a fallback on names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.postings import Index, Layout
from millrace.plans.registry import query
from millrace.sources.tables import Tables

LAYOUT = Layout("doc_id", {"title": 1.0, "body": 0.4, "source": 0.2}, ("title",))
WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
ROWS_SQL = """r AS (SELECT doc_id, source, nullif(split_part(text, chr(10), 1), '') AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) END AS body FROM documents)"""
POSTINGS_SQL = f"""a AS (SELECT doc_id, {WORDS.format("title")} AS t, {WORDS.format("body")} AS b, {WORDS.format("source")} AS s FROM {{}}),
e AS (SELECT doc_id, unnest(t || b || s) AS word, unnest(range(len(t) + len(b) + len(s))) AS place, len(t) AS nt, len(t) + len(b) AS nb FROM a),
w AS (SELECT doc_id, word, max(CASE WHEN place < nt THEN 1.0 WHEN place < nb THEN 0.4 ELSE 0.2 END::DOUBLE) AS weight, list(place ORDER BY place) AS places FROM e GROUP BY doc_id, word)"""


def rows(t: Tables) -> DataFrame:
    """(doc_id, source, title, body): a document's first line and what follows it."""
    text = F.col("text")
    title = F.nullif(F.substring_index(text, "\n", 1), F.lit(""))
    body = F.when(text.contains("\n"), F.substring(text, F.length(F.substring_index(text, "\n", 1)) + 2, F.length(text)))
    return t.documents.select("doc_id", "source", title.alias("title"), body.alias("body"))


@query(f"""
WITH {ROWS_SQL}, k AS (SELECT * FROM r WHERE doc_id % 10 <> 3 OR doc_id % 20 = 3), {POSTINGS_SQL.format("k")}
SELECT word, count(*) AS rows, round(sum(weight), 4) AS weight, sum(len(places))::BIGINT AS places, sum(list_sum(places))::BIGINT AS place_sum FROM w GROUP BY word
""")
def index_increments(t: Tables) -> DataFrame:
    """The words of an index that began with sources alone and had three increments, which bring texts, delete, and bring back; SQL builds it at once."""
    now = rows(t)
    k = F.col("doc_id")
    stale = now.select("doc_id", "source", F.lit("stale words").alias("title"), F.col("source").alias("body"))
    put = lambda df, at, gone=F.lit(False): df.withColumn("at", F.lit(at)).withColumn("gone", gone)
    first = put(now.filter(k % 2 == 0), 1).unionByName(put(stale.filter(k % 2 == 0), 0))
    second = put(now.filter(k % 2 == 1), 2, k % 10 == 3)
    third = put(now.filter(k % 20 == 3), 4).unionByName(put(now.filter(k % 20 == 3), 3, F.lit(True)))
    index = Index.build(stale, LAYOUT)
    for changes in (first, second, third):
        index = index.merge(changes, "at", "gone")
    return index.summary()


@query(f"""
WITH {ROWS_SQL}, {POSTINGS_SQL.format("r")},
g AS (SELECT doc_id, title IS NOT NULL OR body IS NOT NULL OR source IS NOT NULL AS vector, list_distinct(flatten(list_transform({WORDS.format("title")}, lambda x: list_transform(range(1, len(x) + 2), lambda i: substr('  ' || x || ' ', i::BIGINT, 3))))) AS grams FROM r),
q AS (SELECT list_distinct(flatten(list_transform({WORDS.format("'the \"and attion\" -paeux or leaux enenaux'")}, lambda x: list_transform(range(1, len(x) + 2), lambda i: substr('  ' || x || ' ', i::BIGINT, 3))))) AS grams),
n AS (SELECT doc_id, vector, round(len(list_intersect(g.grams, q.grams)) / (len(g.grams) + len(q.grams) - len(list_intersect(g.grams, q.grams))), 6) AS alike FROM g, q),
m AS (SELECT doc_id, max(weight) FILTER (word = 'the') AS w1, max(weight) FILTER (word = 'and') AS w2, max(weight) FILTER (word = 'attion') AS w3, bool_or(word = 'paeux') AS bad, max(weight) FILTER (word = 'leaux') AS w4, max(weight) FILTER (word = 'enenaux') AS w5 FROM w GROUP BY doc_id),
p AS (SELECT DISTINCT x.doc_id FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = 'and' AND y.word = 'attion' AND list_has_any(list_transform(x.places, lambda i: i + 1), y.places)),
h AS (SELECT m.doc_id, greatest(CASE WHEN p.doc_id IS NOT NULL AND NOT bad THEN round((w1 + w2 + w3) / 3, 6) END, round((w4 + w5) / 2, 6)) AS word_rank FROM m LEFT JOIN p USING (doc_id))
SELECT doc_id, coalesce(word_rank, CASE WHEN vector THEN 0 ELSE alike END)::DOUBLE AS rank, CASE WHEN word_rank IS NOT NULL THEN 'words' ELSE 'name' END AS via
FROM n LEFT JOIN h USING (doc_id) WHERE word_rank IS NOT NULL OR alike >= 0.3
""")
def indexed_search(t: Tables) -> DataFrame:
    """All documents that a query with a phrase, an unwanted word and an alternative finds by words, or by a title like it."""
    found = Index.build(rows(t), LAYOUT).search('the "and attion" -paeux or leaux enenaux')
    return found.withColumnRenamed("id", "doc_id")
