"""Browsing: query strings as filters, areas and modes, and filters that exclude one another."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import slug


def identifier(text: Column) -> Column:
    """Lower case, & as and, other runs as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def lookup(value: Column, table: dict[str, str]) -> Column:
    """The table's entry for a value; null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), value) if table else F.lit(None).cast("string")


def canonical(value: Column, aliases: dict[str, list[str]]) -> Column:
    """The name whose aliases hold the value's identifier; null if none does."""
    return lookup(identifier(value), {a: name for name, others in aliases.items() for a in others})


@dataclass(frozen=True)
class Areas:
    """Areas by alias of what a row says, else by its entity; ``alone`` areas hold the one entity given."""

    aliases: dict[str, list[str]]
    by_entity: dict[str, str] = field(default_factory=dict)
    alone: dict[str, str] = field(default_factory=dict)

    def of(self, entity: Column, said: Column | None = None) -> Column:
        known = lookup(entity, self.by_entity)
        return known if said is None else F.coalesce(canonical(said, self.aliases), known)

    def matches(self, entity: Column, said: Column, area: str) -> Column:
        if area in self.alone:
            return entity == self.alone[area]
        return F.coalesce(self.of(entity, said) == area, F.lit(False))

    def same_as(self, origin: Column, entity: Column, said: Column) -> Column:
        """Whether an entity lies in the origin's area; of an origin without area, whether it is the origin."""
        home = self.of(origin)
        alone = reduce(lambda c, kv: F.when(home == kv[0], entity == kv[1]).otherwise(c), self.alone.items(), F.coalesce(self.of(entity, said) == home, F.lit(False)))
        return F.when(home.isNull(), entity == origin).otherwise(alone)


def reachable(entity: Column, mode: str, by_mode: dict[str, list[str]], always: tuple[str, ...] = ("bus", "rideshare")) -> Column:
    """Whether a mode serves an entity; some modes serve all."""
    return F.lit(True) if mode in always else entity.isin(*by_mode[mode]) if by_mode.get(mode) else F.lit(False)


def parameter(query_string: Column, name: str) -> Column:
    """A parameter of a query string, decoded; null if it is missing."""
    found = F.regexp_extract(F.concat(F.lit("&"), F.regexp_replace(query_string, r"^.*\?|#.*$", "")), rf"&{name}=([^&]*)", 1)
    present = F.concat(F.lit("&"), F.regexp_replace(query_string, r"^.*\?|#.*$", "")).contains(f"&{name}=")
    return F.when(present, F.try_url_decode(found))


def parse(query_string: Column, enums: dict[str, tuple[str, ...]], texts: tuple[str, ...] = (), flags: tuple[str, ...] = (), lists: tuple[str, ...] = (), sorts: tuple[str, ...] = ("time",)) -> list[Column]:
    """Typed parameters: unknown values of enumerations are null, flags are true only for "true", lists are tidied, an unknown sort is the first."""
    out = []
    for name, values in enums.items():
        p = parameter(query_string, name)
        out.append(F.when(p.isin(*values), p).alias(name))
    out += [F.nullif(F.trim(parameter(query_string, n)), F.lit("")).alias(n) for n in texts]
    out += [F.coalesce(parameter(query_string, n) == "true", F.lit(False)).alias(n) for n in flags]
    for n in lists:
        items = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(parameter(query_string, n), F.lit("")), ","), slug), lambda x: x != ""))
        out.append(items.alias(n))
    s = parameter(query_string, "sort")
    return [*out, F.coalesce(F.when(s.isin(*sorts), s), F.lit(sorts[0])).alias("sort")]


@dataclass(frozen=True)
class Kind:
    """What is fixed for all rows of one kind: a filter for anything else on these columns leaves nothing."""

    fixed: dict[str, object] = field(default_factory=dict)
    without: tuple[str, ...] = ()  # filters that no row of this kind passes


def contradicts(kind: Kind, wanted: dict[str, object]) -> bool:
    """Whether a filter can pass no row of a kind; known before anything is read."""
    return any(wanted.get(n) for n in kind.without) or any(wanted.get(n) not in (None, "", v) for n, v in kind.fixed.items())


def browse(rows: DataFrame, kind: Kind, wanted: dict[str, object]) -> DataFrame:
    """Rows of a kind that pass the filter: equal in each wanted column that isn't fixed."""
    if contradicts(kind, wanted):
        return rows.limit(0)
    tests = [F.col(c) == v for c, v in wanted.items() if v not in (None, "", False) and c not in kind.fixed]
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def engine_filter(values: dict[str, Column], flags: dict[str, tuple[Column, str]]) -> Column:
    """A search engine's filter text: ``name:=[`value`]`` for every value that isn't null, and a flag's own text where it is set, joined by &&."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{n}:=[`"), c, F.lit("`]"))) for n, c in values.items()]
    return F.concat_ws(" && ", *parts, *[F.when(c, F.lit(text)) for c, text in flags.values()])


def engine_query(text: Column, filter_by: Column, fields: dict[str, int], one_typo_from: int = 4, two_typos_from: int = 7, page: int = 50) -> Column:
    """A search engine's query: typos by the words' lengths, weights by field, prefix on the last word only."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")
    longest = F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))
    typos = F.when(longest < one_typo_from, 0).when(longest < two_typos_from, 1).otherwise(2)
    return F.struct(
        F.when(F.size(words) == 0, "*").otherwise(F.array_join(words, " ")).alias("q"),
        F.lit(",".join(fields)).alias("query_by"),
        F.lit(",".join(map(str, fields.values()))).alias("weights"),
        typos.alias("num_typos"),
        filter_by.alias("filter_by"),
        F.lit(page).alias("per_page"),
    )
