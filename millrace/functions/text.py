"""Text normalisation, quality measures and identifiers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: the characters of sound titles.
TITLE_CHARACTERS = r"""A-Za-z0-9\s'\u2019":,&.!?-"""


def squash(text: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def tokens(text: Column, least: int = 2) -> Column:
    """Runs of letters and digits, lower-cased, of at least ``least`` characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def expand_synonyms(words: Column, synonyms: dict[str, list[str]]) -> Column:
    """The words and, after them, their synonyms and the synonyms' parts; the first of each stays."""
    table = F.create_map(*[x for k, v in sorted(synonyms.items()) for x in (F.lit(k), F.lit(v))])
    found = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.lit([]).cast("array<string>"))))
    parts = F.flatten(F.transform(found, lambda s: F.split(s, " ")))
    return F.array_distinct(F.concat(words, found, parts))


def contained_count(words: Column, text: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def contains_all(words: Column, text: Column) -> Column:
    """Every word is a substring; true for no words."""
    return F.forall(words, lambda w: F.contains(text, w))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def compact_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def fold_marks(text: Column) -> Column:
    """Typographic dashes and quotes as their ASCII forms, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(text, "–—‘’“” ", "--''\"\" "), r"\s+", " "))


def collapse_repeat(text: Column) -> Column:
    """One of a phrase that is written twice in a row."""
    return F.regexp_replace(text, r"^(.+?)\s+\1$", "$1")


def title_case(text: Column, small: tuple[str, ...] = ("a", "an", "and", "at", "by", "for", "in", "of", "on", "or", "the", "to")) -> Column:
    """Capitalised words, small ones excepted unless they come first."""
    words = F.split(squash(text), " ")
    return F.array_join(F.transform(words, lambda w, k: F.when((k > 0) & w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), F.substring(w, 2, 1 << 30)))), " ")


def letter_spaced(text: Column, least: int = 4, share: float = 0.65) -> Column:
    """Whether letters stand apart: at least ``least`` words of letters, that share of them of one or two letters."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.rlike("^[A-Za-z]+$"))
    short = F.size(F.filter(words, lambda w: F.length(w) <= 2))
    return F.coalesce((F.size(words) >= least) & (short >= F.size(words) * share), F.lit(False))


def garbage_ratio(text: Column) -> Column:
    """The share of characters that are none of those a title has, years in brackets and white space around left out; 1 for empty texts, 0 for nothing but a year."""
    own = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(own, r"\([0-9]{4}\)", ""), r"^\s+|\s+$", "")
    return F.when(own == "", 1.0).when(rest == "", 0.0).otherwise(F.regexp_count(rest, F.lit(f"[^{TITLE_CHARACTERS}]")) / F.length(rest))


def keyword_labels(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Labels of all (label, pattern) rules that match, in order; the default if none does."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules]))
    return found if default is None else F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def first_label(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first (label, pattern) rule that matches."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules], F.lit(default))


def money_cents(text: Column) -> Column:
    """All dollar amounts of a text in cents, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\$([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\.[0-9]{2})?"), F.lit(0))
    return F.transform(found, lambda a: F.floor(F.regexp_replace(a, "[$,]", "").cast("decimal(18,2)") * 100).cast("long"))


def url_path(url: Column) -> Column:
    """The path of a url, or of what is a path already; / if there is none."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", "")
    path = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.when(path == "", "/").otherwise(path)


def short_id(text: Column, digits: int = 24) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, digits)


def md5_uuid(text: Column) -> Column:
    """A name's stable identifier in the form of a UUID."""
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def content_hash(*columns: Column) -> Column:
    """The SHA-256 of values in the given order, apart from one another; null differs from the empty string."""
    marked = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *marked), 256)


def escape_calendar(text: Column) -> Column:
    """Text as a calendar file wants it: backslash, semicolon, comma and line end escaped."""
    steps = [("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])
