"""Graph documents: one JSON text a graph, read into five relations, with a report of broken references.

A document has places, stops (at a place), patterns (of stops), edges (between stops, of a pattern) and services (between places, over edges).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.schedules import once

#: The members of a document and of their items.
SCHEMA = (
    "places array<struct<id:string>>, stops array<struct<id:string,place:string>>, patterns array<struct<id:string,stops:array<string>>>, "
    "edges array<struct<id:string,from:string,to:string,pattern:string>>, services array<struct<id:string,origin:string,destination:string,edges:array<string>>>"
)
#: What refers to what: relation, then (member, relation referred to); members can be lists.
REFERENCES = {
    "places": [],
    "stops": [("place", "places")],
    "patterns": [("stops", "stops")],
    "edges": [("from", "stops"), ("to", "stops"), ("pattern", "patterns")],
    "services": [("origin", "places"), ("destination", "places"), ("edges", "edges")],
}
LISTS = {("patterns", "stops"), ("services", "edges")}


def parsed(docs: DataFrame, graph: str, text: str) -> DataFrame:
    """(graph, d): each document parsed once; text that is no such document gives null."""
    sound = F.startswith(F.ltrim(text), F.lit("{")) & F.try_parse_json(text).isNotNull()
    return docs.select(F.col(graph).alias("graph"), F.when(sound, F.from_json(text, SCHEMA)).alias("d"))


def relations(docs: DataFrame) -> dict[str, DataFrame]:
    """The five tables of :func:`parsed` documents, each with the graph."""
    return {name: docs.select("graph", F.inline(F.col("d")[name])) for name in REFERENCES}


FAULT = "array<struct<relation:string,id:string,field:string,ref:string,fault:string>>"


def _fault(relation: Column, name: Column, field: Column, ref: Column, kind: str) -> Column:
    return F.struct(relation.cast("string").alias("relation"), name.cast("string").alias("id"), field.cast("string").alias("field"), ref.cast("string").alias("ref"), F.lit(kind).alias("fault"))


def _faults(items: dict[str, Column], unread: Column) -> Column:
    """All faults of a graph whose relations are the arrays ``items``.

    Sets of texts are compared by hash and repeats found by sorting; only where some reference is missing are the items' references looked through.
    """
    none = F.lit(None).cast("string")

    def named(name: str) -> Column:
        return F.filter(F.transform(items[name], lambda i: i["id"]), lambda k: F.coalesce(k, F.lit("")) != "")

    def repeated(name: str) -> Column:
        again = once(F.array_sort(named(name)), lambda ids: F.array_distinct(F.filter(ids, lambda k, n: (n > 0) & (k == F.get(ids, n - 1)))))
        return F.transform(again, lambda k: _fault(F.lit(name), k, F.lit("id"), none, "repeated"))

    def unnamed(name: str) -> Column:
        blank = F.filter(F.transform(items[name], lambda i: i["id"]), lambda k: F.coalesce(k, F.lit("")) == "")
        return F.transform(blank, lambda k: _fault(F.lit(name), k, F.lit("id"), none, "unnamed"))

    def orphans(name: str, field: str, to: str) -> Column:
        held = lambda i: F.array_compact(F.coalesce(i[field] if (name, field) in LISTS else F.array(i[field]), F.array().cast("array<string>")))
        of = lambda i, missing: F.transform(F.array_intersect(held(i), missing), lambda r: _fault(F.lit(name), i["id"], F.lit(field), r, "orphan"))
        all_of = lambda missing: F.when(F.size(missing) > 0, F.flatten(F.transform(items[name], lambda i: of(i, missing)))).otherwise(F.array().cast(FAULT))
        return once(F.array_except(F.flatten(F.transform(items[name], held)), named(to)), all_of)

    found = [f(name).cast(FAULT) for name in REFERENCES for f in (repeated, unnamed)]
    found += [orphans(name, field, to).cast(FAULT) for name, refs in REFERENCES.items() for field, to in refs]
    return F.concat(*found, F.array_repeat(_fault(none, none, none, none, "unread"), unread).cast(FAULT))


def integrity(docs: DataFrame) -> DataFrame:
    """(graph, relation, id, field, ref, fault) of :func:`parsed` documents: every orphaned reference, repeated id, item without id and unreadable document.

    Documents of one graph count as one. A graph is judged in its own row, so nothing is shuffled that isn't dealt by graph already and only faults become rows.
    """
    whole = docs.groupBy("graph").agg(F.collect_list("d").alias("ds"), F.count_if(F.col("d").isNull()).cast("int").alias("unread"))
    joined = lambda name: F.flatten(F.filter(F.transform("ds", lambda d: d[name]), lambda x: x.isNotNull()))
    graphs = whole.select("graph", "unread", F.struct(*[joined(name).alias(name) for name in REFERENCES]).alias("g"))
    return graphs.select("graph", F.inline(_faults({name: F.col("g")[name] for name in REFERENCES}, F.col("unread"))))
