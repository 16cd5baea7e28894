"""Readers and sinks: tolerant JSON lines, page text, calendars, reports and tables of files."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import escape_calendar

#: Elements whose text is not read, and elements that end a line.
SKIPPED = {"script", "style", "svg", "noscript"}
BLOCKS = {"article", "aside", "br", "dd", "div", "dl", "dt", "figcaption", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "nav", "ol", "p", "section", "table", "tbody", "td", "th", "thead", "tr", "ul"}


def _object(text: Column, schema: T.StructType) -> Column:
    """The schema's members of a JSON object, null if the text is none; members of other types or absent ones are null, unknown ones left out."""
    checked = F.from_json(text, T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    # A variant tells objects from all else; names that come twice, which it refuses, pass by the schema.
    known = F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT")) | checked["_bad"].isNull()
    return F.when(F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{")) & F.coalesce(known, F.lit(False)), F.from_json(text, schema))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines: a row for every line that is an object, whatever its members; other lines are left out."""
    return spark.read.text(path).select(_object(F.col("value"), schema).alias("o")).filter("o is not null").select("o.*")


def json_envelope(text: Column, item: str, member: str = "rows") -> Column:
    """Items of a JSON text that is a list of objects, an object with such a list, or a single object."""
    as_list = F.from_json(text, f"array<{item}>")
    as_member = F.from_json(text, f"struct<{member}: array<{item}>>")[member]
    single = F.from_json(text, item)
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), as_list).otherwise(F.coalesce(as_member, F.array_compact(F.array(single))))


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.parts, self.lines = 0, [], []

    def _end(self) -> None:
        for line in "".join(self.parts).splitlines():  # a line of the source ends a line, too
            if text := " ".join(line.split()):
                self.lines.append(text)
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self._end()

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            self.parts.append(data)


def lines_of(html: str | None) -> list[str]:
    """The text lines of a page."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._end()
    return parser.lines


def page_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, line, text): the pages' text lines, from 1. Pages stream through Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, line) for k, page in zip(b[key], b[html], strict=True) for n, line in enumerate(lines_of(page), 1)]
            yield pd.DataFrame(rows, columns=[key, "line", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, line int, text string")


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", tags: tuple[str, ...] = ("h1", "h2", "h3", "h4", "p", "li", "td")) -> DataFrame:
    """(key, place, tag, text): the blocks of pages in order, by SQL functions alone; a block inside another is part of it."""
    pattern = "(?is)" + "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}>" for t in tags)
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).alias("place", "b"))
    text = F.trim(F.regexp_replace(F.regexp_replace("b", "(?s)<[^>]*>", " "), r"\s+", " "))
    return found.select(key, "place", F.lower(F.regexp_extract("b", "^<([A-Za-z0-9]+)", 1)).alias("tag"), text.alias("text")).filter("text <> ''")


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, place, href, label): the anchors of pages, by SQL functions alone."""
    anchors = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?[^"'\s>]+["']?[^>]*>.*?</a>"""), F.lit(0))
    found = pages.select(key, F.posexplode(anchors).alias("place", "a"))
    label = F.trim(F.regexp_replace(F.regexp_replace("a", "(?s)<[^>]*>", ""), r"\s+", " "))
    return found.select(key, "place", F.regexp_extract("a", r"""(?is)href\s*=\s*["']?([^"'\s>]+)""", 1).alias("href"), label.alias("label"))


def sniff(data: Column, name: Column) -> Column:
    """A document's kind by its first bytes, else by its name."""
    head, low = F.hex(F.substring(data, 1, 8)), F.lower(name)
    by_bytes = F.when(head.startswith("255044462D"), "pdf").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png")
    return by_bytes.when(low.endswith(".pdf"), "pdf").when(low.rlike(r"\.jpe?g$"), "jpeg").when(low.endswith(".png"), "png").otherwise("unknown")


def calendar_text(df: DataFrame, key: str, uid: str, title: str, start: str, end: str) -> DataFrame:
    """(key, ics): one calendar file's text for each key, events in order of start; rows without start are left out."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    lines = ["BEGIN:VEVENT", F.concat(F.lit("UID:"), F.col(uid).cast("string")), F.concat(F.lit("SUMMARY:"), escape_calendar(F.col(title))), F.concat(F.lit("DTSTART:"), stamp(start)), F.concat(F.lit("DTEND:"), stamp(end)), "END:VEVENT"]
    event = F.concat_ws("\r\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    rows = df.filter(F.col(start).isNotNull()).withColumn("_e", F.struct(F.col(start), F.col(uid), event.alias("text")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["text"]), "\r\n")
    return rows.groupBy(key).agg(F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n"), body, F.lit("\r\nEND:VCALENDAR")).alias("ics"))


def markdown_table(rows: DataFrame, limit: int = 100) -> str:
    """A small report as a markdown table; at most ``limit`` rows come to the driver."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows.limit(limit).collect())])


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Append or replace a table of files: parquet, orc, json or csv (with a header)."""
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files, each a list of objects or one object; other members of lists are left out; an empty table where there is no file; text that is no JSON gives no rows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    of = T.StructType.fromDDL(schema)
    whole = spark.read.option("wholetext", True).text(path).select("value", F.try_parse_json("value").alias("v"))
    listed = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    members = F.when(listed, F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda m: F.to_json(m))).otherwise(F.array("value"))
    return whole.select(F.explode(members).alias("m")).select(_object(F.col("m"), of).alias("o")).filter("o is not null").select("o.*")


def distinct_urls(*feeds: tuple[DataFrame, str]) -> DataFrame:
    """(url): the trimmed urls of several feeds without blanks, each once."""
    out = None
    for feed, column in feeds:
        one = feed.select(F.trim(F.col(column)).alias("url")).filter("url <> ''")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def document_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row a file of binaryFile: its digest, size, kind by first bytes or name, and name."""
    name = F.element_at(F.split(path, "/"), -1)
    return files.select(F.sha2(F.col(content), 256).alias("content_sha256"), F.octet_length(content).cast("long").alias("size"), sniff(F.col(content), name).alias("kind"), name.alias("name"))


def missing_tables(spark: SparkSession, expected: list[str]) -> DataFrame:
    """(name, present) of expected tables and views of the session's catalogue."""
    there = {t.name.lower() for t in spark.catalog.listTables()}
    return spark.range(1).select(F.explode(F.lit(expected)).alias("name")).withColumn("present", F.lower("name").isin(*there) if there else F.lit(False))


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A table or view of the catalogue in the given columns, or no rows where it doesn't exist; columns that it lacks are null, any other fault is raised when it is read."""
    wanted = T.StructType.fromDDL(schema)
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame([], wanted)
    held = spark.table(name)
    return held.select(*[(F.col(f"`{f.name}`") if f.name in held.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
