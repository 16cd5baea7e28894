"""Parts, suppliers and customers as browsable items: one facet schema, query strings, areas, modes, presets and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import temporal as T
from millrace.operators import browse, ranking
from millrace.plans.registry import query
from millrace.sources.tables import Tables

FIT_SQL = "CASE WHEN contains(lower(x), 'bolt') OR contains(lower(x), 'gear') THEN 'indoor' WHEN contains(lower(x), 'ring') THEN 'covered' ELSE 'open' END"


def weather_fit(explicit: F.Column, known: F.Column, text: F.Column) -> F.Column:
    """Indoor or covered if stated, else what is known of the item, else what its text suggests."""
    low = F.lower(text)
    inferred = F.when(low.contains("bolt") | low.contains("gear"), "indoor").when(low.contains("ring"), "covered").otherwise("open")
    return F.coalesce(F.when(explicit.isin("indoor", "covered"), explicit), known, inferred)


def booking_status(required: F.Column, recommended: F.Column, walk_ups: F.Column, evidence: F.Column) -> F.Column:
    """required, recommended, walkup_only or not_required_verified (both only with evidence that none is required), else unknown."""
    free = evidence & required.isNotNull() & ~required
    return (
        F.when(F.coalesce(required, F.lit(False)), "required")
        .when(F.coalesce(recommended, F.lit(False)), "recommended")
        .when(F.coalesce(walk_ups, F.lit(False)) & free, "walkup_only")
        .when(free, "not_required_verified")
        .otherwise("unknown")
    )


ITEMS_SQL = f"""items AS (
  SELECT 'part-' || p_partkey AS id, 'part' AS kind, p_brand AS entity, p_type AS category, CASE WHEN p_size < 11 THEN 'morning' WHEN p_size < 17 THEN 'afternoon' WHEN p_size < 21 THEN 'evening' ELSE 'late' END AS daypart,
    p_retailprice < 950 AS free, CASE WHEN p_size % 7 = 0 THEN 'covered' ELSE (SELECT {FIT_SQL.replace("(x)", "(p_name)")}) END AS fit, p_size % 5 = 0 OR p_size % 5 = 1 AS reservation,
    CASE p_size % 5 WHEN 0 THEN 'required' WHEN 1 THEN 'recommended' WHEN 2 THEN 'walkup_only' WHEN 3 THEN 'not_required_verified' ELSE 'unknown' END AS booking, p_name AS title FROM part
  UNION ALL SELECT 'supplier-' || s_suppkey, 'supplier', 'nation-' || s_nationkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END, NULL, s_acctbal < 1000,
    CASE WHEN s_nationkey = 7 THEN 'covered' ELSE 'open' END, s_suppkey % 3 < 2, CASE s_suppkey % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'recommended' ELSE 'unknown' END, s_name FROM supplier
  UNION ALL SELECT 'customer-' || c_custkey, 'customer', 'nation-' || c_nationkey, 'customers', CASE WHEN c_custkey % 4 = 0 THEN 'late' ELSE 'evening' END, true, NULL, false, 'not_required_verified', c_name FROM customer)"""


def facet_items(t: Tables) -> DataFrame:
    """Three tables under one facet schema: computed facts, defaults by key, constants."""
    z, s = F.col("p_size"), F.col("s_suppkey")
    required, recommended = F.when(z % 5 != 4, z % 5 == 0), z % 5 == 1
    fit = weather_fit(F.when(z % 7 == 0, "covered"), F.lit(None).cast("string"), F.col("p_name"))
    parts = t.part.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.lit("part").alias("kind"), F.col("p_brand").alias("entity"), F.col("p_type").alias("category"), T.daypart(z * 60).alias("daypart"),
        (F.col("p_retailprice") < 950).alias("free"), fit.alias("fit"), (F.coalesce(required, F.lit(False)) | recommended).alias("reservation"), booking_status(required, recommended, z % 5 == 2, z % 5 != 4).alias("booking"), F.col("p_name").alias("title"),
    )
    nation = lambda c: F.concat(F.lit("nation-"), F.col(c).cast("string"))
    status = booking_status(s % 3 == 0, s % 3 == 1, F.lit(False), F.lit(False))
    suppliers = t.supplier.select(
        F.concat(F.lit("supplier-"), s.cast("string")).alias("id"), F.lit("supplier").alias("kind"), nation("s_nationkey").alias("entity"), F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("category"),
        F.lit(None).cast("string").alias("daypart"), (F.col("s_acctbal") < 1000).alias("free"), weather_fit(F.lit(None).cast("string"), browse.lookup(nation("s_nationkey"), {"nation-7": "covered"}), F.lit("")).alias("fit"),
        (s % 3 < 2).alias("reservation"), status.alias("booking"), F.col("s_name").alias("title"),
    )
    customers = t.customer.select(
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("id"), F.lit("customer").alias("kind"), nation("c_nationkey").alias("entity"), F.lit("customers").alias("category"),
        F.when(F.col("c_custkey") % 4 == 0, "late").otherwise("evening").alias("daypart"), F.lit(True).alias("free"), F.lit(None).cast("string").alias("fit"), F.lit(False).alias("reservation"), F.lit("not_required_verified").alias("booking"), F.col("c_name").alias("title"),
    )
    return parts.unionByName(suppliers).unionByName(customers)


@query(f"WITH {ITEMS_SQL} SELECT * FROM items")
def facet_projection(t: Tables) -> DataFrame:
    """All items under one facet schema."""
    return facet_items(t)


#: Filters tried on one kind whose rows are all of one category, have no weather fit and take no reservations.
TRIED = [{"category": "customers", "daypart": "late"}, {"category": "bolts"}, {"fit": "indoor"}, {"reservation": True}, {"daypart": "evening"}, {}]


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT daypart FROM items WHERE kind = 'customer')
SELECT * FROM (VALUES (0, (SELECT count(*) FILTER (daypart = 'late') FROM c)), (1, 0), (2, 0), (3, 0), (4, (SELECT count(*) FILTER (daypart = 'evening') FROM c)), (5, (SELECT count(*) FROM c))) v(tried, n)""")
def contradictory_filters(t: Tables) -> DataFrame:
    """Rows that each of several filters leaves of one kind; filters against what is fixed leave none."""
    rows = facet_items(t).filter("kind = 'customer'")
    kind = browse.Kind({"category": "customers"}, ("fit", "reservation"))
    out = None
    for k, wanted in enumerate(TRIED):
        one = browse.browse(rows, kind, wanted).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("tried"), "n")
        out = one if out is None else out.unionByName(one)
    return out


DAYPARTS = ("morning", "afternoon", "evening", "late", "anytime")
STRING_SQL = """q AS (SELECT p_partkey AS k, '/browse?daypart=' || ['morning', 'noon', 'late'][1 + p_size % 3] || '&free=' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE '1' END
  || CASE WHEN p_size % 4 = 0 THEN '' ELSE '&resort=' || replace(p_name, ' ', '%20') || ',,' || p_brand || ',' || replace(p_name, ' ', '%20') END || '&sort=' || ['price', 'time', 'fame'][1 + p_size % 3] || '&q=' || replace(p_name, ' ', '+') || '#top' AS url FROM part)"""


def _strings(t: Tables) -> DataFrame:
    z, name = F.col("p_size"), F.replace(F.col("p_name"), F.lit(" "), F.lit("%20"))
    pick = lambda *v: F.element_at(F.lit(list(v)), (z % 3 + 1).cast("int"))
    resort = F.when(z % 4 == 0, "").otherwise(F.concat(F.lit("&resort="), name, F.lit(",,"), F.regexp_replace("p_brand", "#", "%23"), F.lit(","), name))
    url = F.concat(F.lit("/browse?daypart="), pick("morning", "noon", "late"), F.lit("&free="), F.when(z % 2 == 0, "true").otherwise("1"), resort, F.lit("&sort="), pick("price", "time", "fame"), F.lit("&q="), F.replace(F.col("p_name"), F.lit(" "), F.lit("+")), F.lit("#top"))
    return t.part.select(F.col("p_partkey").alias("k"), url.alias("url"))


@query("""
SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'morning' WHEN 2 THEN 'late' END AS daypart, p_name AS q, p_size % 2 = 0 AS free,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE replace(p_name, ' ', '-') || ',' || lower(replace(p_brand, '#', '-')) END AS resort, CASE WHEN p_size % 3 = 0 THEN 'price' ELSE 'time' END AS sort FROM part
""")
def query_strings(t: Tables) -> DataFrame:
    """Query strings as typed filters; unknown values are dropped."""
    parsed = browse.parse(F.col("url"), {"daypart": DAYPARTS}, ("q",), ("free",), ("resort",), ("time", "price", "name"))
    return _strings(t).select("k", *parsed).withColumn("resort", F.array_join("resort", ","))


ALIASES = {"north": ["europe", "europe_area"], "south": ["africa", "america", "africa_america"], "east": ["asia", "middle_east"]}
BY_NATION = {"NATION_3": "south", "NATION_4": "island", "NATION_8": "north", "NATION_12": "east", "NATION_13": "island"}
MODES = {"boat": ["NATION_4", "NATION_13", "NATION_20"], "rail": ["NATION_1", "NATION_3"]}
AREA_SQL = """CASE WHEN r_name = 'EUROPE' THEN 'north' WHEN r_name IN ('AFRICA', 'AMERICA') THEN 'south' WHEN r_name IN ('ASIA', 'MIDDLE EAST') THEN 'east'
  ELSE CASE n_name WHEN 'NATION_3' THEN 'south' WHEN 'NATION_4' THEN 'island' WHEN 'NATION_8' THEN 'north' WHEN 'NATION_12' THEN 'east' WHEN 'NATION_13' THEN 'island' END END"""


@query(f"""
WITH n AS (SELECT n_name, {AREA_SQL} AS area FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT n_name, area, coalesce(area = 'south', false) AS in_south, n_name = 'NATION_4' AS in_island, coalesce(area = 'north', false) AS near_8, n_name = 'NATION_5' AS near_5, true AS by_bus, n_name IN ('NATION_4', 'NATION_13', 'NATION_20') AS by_boat, false AS by_balloon FROM n
""")
def area_predicates(t: Tables) -> DataFrame:
    """Nations by area, nearness to an origin and mode."""
    areas = browse.Areas(ALIASES, BY_NATION, {"island": "NATION_4"})
    n, said = F.col("n_name"), F.col("r_name")
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_name", areas.of(n, said).alias("area"), areas.matches(n, said, "south").alias("in_south"), areas.matches(n, said, "island").alias("in_island"),
        areas.same_as(F.lit("NATION_8"), n, said).alias("near_8"), areas.same_as(F.lit("NATION_5"), n, said).alias("near_5"),
        browse.reachable(n, "bus", MODES).alias("by_bus"), browse.reachable(n, "boat", MODES).alias("by_boat"), browse.reachable(n, "balloon", MODES).alias("by_balloon"),
    )


@query(f"""
WITH {ITEMS_SQL}
SELECT id, CASE WHEN len(q) = 0 THEN '*' ELSE q END AS q, num_typos, filter_by FROM (SELECT id, lower(title) AS q,
  (SELECT CASE WHEN max(length(w)) < 4 THEN 0 WHEN max(length(w)) < 7 THEN 1 ELSE 2 END FROM unnest(string_split(title, ' ')) u(w))::INTEGER AS num_typos,
  concat_ws(' && ', 'category:=[`' || category || '`]', 'daypart:=[`' || daypart || '`]', CASE WHEN free THEN 'free:=true' END, CASE WHEN reservation THEN '(required:=true || recommended:=true)' END) AS filter_by FROM items)
""")
def engine_queries(t: Tables) -> DataFrame:
    """What a search engine would be asked for items like each."""
    c = F.col
    text = browse.engine_filter({"category": c("category"), "daypart": c("daypart")}, {"free": (c("free"), "free:=true"), "reservation": (c("reservation"), "(required:=true || recommended:=true)")})
    spec = browse.engine_query(c("title"), text, {"title": 4, "category": 2})
    return facet_items(t).select("id", spec.alias("s")).select("id", "s.q", "s.num_typos", "s.filter_by")


#: Presets: name and what items they take.
PRESETS = {
    "free": "free", "tonight": "daypart IN ('evening', 'late')", "morning": "daypart = 'morning'", "rainy": "fit IN ('indoor', 'covered')", "walk_in": "booking IN ('walkup_only', 'not_required_verified')",
    "book_ahead": "booking = 'required'", "no_debt": "category <> 'debt'", "promo": "category = 'PROMO'", "unclear": "booking = 'unknown'", "free_evening": "free AND daypart = 'evening'",
}


@query(f"WITH {ITEMS_SQL} " + " UNION ALL ".join(f"SELECT '{name}' AS preset, kind, count(*) AS n FROM items WHERE {test} GROUP BY kind" for name, test in PRESETS.items()))
def preset_counts(t: Tables) -> DataFrame:
    """How many items of each kind ten presets take, counted in one pass."""
    hits = F.array(*[F.when(F.coalesce(F.expr(test), F.lit(False)), F.lit(name)) for name, test in PRESETS.items()])
    return facet_items(t).select("kind", F.explode(F.array_compact(hits)).alias("preset")).groupBy("preset", "kind").agg(F.count(F.lit(1)).alias("n"))


ORDERS = {
    "price": "p_retailprice, p_name, p_partkey", "price_desc": "p_retailprice DESC, p_name, p_partkey", "name": "p_name, p_partkey", "size": "p_size, p_partkey", "brand": "p_brand, p_size DESC, p_partkey",
    "type": "CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END, p_partkey", "odd_first": "CASE WHEN p_size % 2 = 1 THEN p_size END NULLS LAST, p_partkey",
}


@query(" UNION ALL ".join(f"(SELECT '{n}' AS sort, p_partkey, row_number() OVER (ORDER BY {o}) AS place FROM part ORDER BY {o} LIMIT 20)" for n, o in ORDERS.items()))
def seven_sorts(t: Tables) -> DataFrame:
    """The first twenty parts in each of seven orders."""
    out = None
    for name, order in ORDERS.items():
        by = [F.expr(p.split(" ")[0] if p.endswith(" DESC") else p.replace(" NULLS LAST", "")) for p in order.split(", ")]
        keys = [b.desc() if p.endswith(" DESC") else b.asc_nulls_last() for b, p in zip(by, order.split(", "), strict=True)]
        one = ranking.numbered_top(t.part, keys, 20).select(F.lit(name).alias("sort"), "p_partkey", "place")
        out = one if out is None else out.unionByName(one)
    return out
