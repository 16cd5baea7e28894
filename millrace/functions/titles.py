"""Titles and labels as people and scanners write them: damage, repairs, keys and vocabularies, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import compact_key, squash


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def share(part: Column, whole: Column) -> Column:
    """part / whole; null for nothing."""
    return F.try_divide(part.cast("double"), whole)


def boilerplate(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text is empty, has leaders of four dots or more, or holds one of the phrases."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return reduce(lambda a, p: a | low.contains(p), phrases, (low == "") | low.rlike(r"\.{4,}"))


def corrupt_title(text: Column, phrases: tuple[str, ...] = (), longest: int = 80) -> Column:
    """Whether a title can't be shown: empty, too long, one character five times in a row, boilerplate, letters apart, or few letters."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = words_of(t)
    n = F.size(words)
    single, short = F.size(F.filter(words, lambda w: F.length(w) == 1)), F.size(F.filter(words, lambda w: F.length(w) <= 2))
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    apart = (n >= 4) & ((single >= 3) | (short >= n * 0.65))
    return (t == "") | (F.length(t) > longest) | t.rlike(r"(?i)(.)\1{4,}") | boilerplate(t, phrases) | apart | ((letters > 0) & (letters < F.length(t) * 0.35))


def corrupt_slug(slug: Column) -> Column:
    """Whether a slug comes from letters set apart: five parts, 55 % of one letter; or three, all of two at most, 14 characters in all."""
    low = F.lower(F.trim(F.coalesce(slug, F.lit(""))))
    parts = F.filter(F.split(low, "-"), lambda p: p != "")
    n, single = F.size(parts), F.size(F.filter(parts, lambda p: F.length(p) == 1))
    return (n == 0) | ((n >= 5) & (single >= n * 0.55)) | ((n >= 3) & F.forall(parts, lambda p: F.length(p) <= 2) & (F.length(low) <= 14))


def _closed_up(part: Column) -> Column:
    """R E E L Fun as REEL Fun cut where a capital follows a small letter, in title case, if letters stand apart."""
    words = words_of(part)
    spaced = (F.size(words) >= 4) & (F.size(F.filter(words, lambda w: F.length(w) <= 2)) >= F.size(words) * 0.65)
    cut = F.split(F.regexp_replace(F.array_join(words, ""), "([a-z])([A-Z])", "$1 $2"), "[ -]")
    cased = F.transform(F.filter(cut, lambda w: w != ""), lambda w: F.when(w.rlike("^[0-9]+$") | ((F.length(w) <= 2) & (w == F.upper(w))), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))))
    return F.when(spaced, F.array_join(cased, " ")).otherwise(F.array_join(words, " "))


def close_up(text: Column, repairs: dict[str, str] | None = None) -> Column:
    """A title with letters closed up, part by part between dashes; titles known by their compact key become what they should be."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    out = F.array_join(F.transform(F.split(flat, " - "), _closed_up), " - ")
    return out if not repairs else F.coalesce(repair(flat, repairs), out)


def repair(text: Column, repairs: dict[str, str]) -> Column:
    """The repair of a title known by its letters and digits; null if it isn't."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(repairs.items()) for x in kv]), compact_key(text))


def clean_tail(text: Column) -> Column:
    """A quoted title, else the text, without unfinished brackets and ratings at its end, one of a phrase written twice."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    quoted = F.regexp_extract(flat, '"([^"]+)"', 1)
    body = F.when(quoted != "", quoted).otherwise(flat)
    for pattern in (r"\s*[\[(][^\])]{0,4}$", r"(?i)(?:\s+|\s*[\[(]\s*)(?:g|pg|pg-13)\s*[\])]?\s*$", r"\s+&\s*$"):
        body = F.when(F.regexp_replace(body, pattern, "") != "", F.regexp_replace(body, pattern, "")).otherwise(body)
    return F.regexp_replace(F.trim(body), r"^(.+?)\s+\1$", "$1")


def rejected_title(text: Column, allowed: tuple[str, ...], places: str) -> Column:
    """Whether a title is none: empty, a rating, a time or a place; titles that hold an allowed one are titles."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    fine = reduce(lambda a, p: a | low.contains(p.lower()), allowed, F.lit(False))
    return (low == "") | low.isin("g", "pg", "pg-13", "p", "s") | (~fine & (low.rlike(r"\b(am|pm)\b|[0-9]{1,2}:[0-9]{2}") | low.rlike(places)))


def bleed(description: Column, category: Column, rules: dict[str, str], keep: int = 120) -> Column:
    """The beginning of a description that holds the marks of another category; null if none does."""
    text = F.trim(F.coalesce(description, F.lit("")))
    return F.coalesce(*[F.when(text.rlike(p) & ~category.eqNullSafe(F.lit(owner)), F.substring(text, 1, keep)) for owner, p in rules.items()])


def scanned_words(text: Column) -> Column:
    """Words of scanned text: + read as h, | as i, & as and, a fee's mark ($) left out."""
    read = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), [("($)", " "), ("&", " and "), ("+", "h"), ("|", "i")], F.lower(F.coalesce(text, F.lit(""))))
    return F.filter(F.split(read, "[^a-z0-9]+"), lambda w: w != "")


#: What scanners make of schedule texts, and what was printed, in the order of repair.
CLOCK_REPAIRS = [
    (r"(?i)\bfro\*\s*([0-9])", "from $1"),
    (r"(?i)\ba1d\b", "and"),
    (r"(?i)(?:=|\b)ro([0-9])", "from $1"),
    (r"(?i)\bI([0-9]{1,2}:[0-9]{2}\s*[ap]\.?m\.?)", "$1"),
    (r"(?i)\b([0-9]{1,2})\.([0-9]{2}\s*[ap]\.?m\.?)", "$1:$2"),
    (r"(?i)\b([0-9]{1,2}:[0-9]{2})0m\b", "$1am"),
    (r"(?i)\b([0-9]{1,2}:)o([0-9o]\s*[ap]\.?m\.?)", "$10$2"),
    (r"(?i)\b([0-9]{1,2}:[0-9])o(\s*[ap]\.?m\.?)", "$10$2"),
    (r"(?i)([0-9]:)o([0-9])", "$10$2"),
    (r"(?i)([0-9]:[0-9])o(\s*[ap]\.?m\.?)", "$10$2"),
]


def clean_line(text: Column) -> Column:
    """One line with single spaces, plain dashes and apostrophes; empty for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\u2013\u2014\u2019", "--'")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def repair_clock(text: Column) -> Column:
    """A schedule text with what scanners misread in times mended: letters O for zeros, dots for colons, lost letters of "from", "and" and "am"."""
    return reduce(lambda c, s: F.regexp_replace(c, *map(F.lit, s)), CLOCK_REPAIRS, clean_line(text))


def canonical_title(text: Column, known: dict[str, str], ratings: bool = True) -> Column:
    """Lower case, a space after !, ? and :, ratings at the end left out; titles known by their compact key are the known one."""
    t = squash(F.coalesce(text, F.lit("")))
    spaced = F.regexp_replace(t, "([!?:])([a-z])", "$1 $2")
    bare = F.regexp_replace(spaced, r"\s*[\[(]\s*(?:g|pg|pg-13)\s*[\])]?\s*$", "") if ratings else spaced
    return F.coalesce(repair(t, known), F.trim(bare))


def agreement(a: Column, b: Column, special: list[tuple[str, str, str]]) -> Column:
    """(status, value): exact if both canonical titles are equal or one of the special pairs (first, second, result), else disagreement with the first."""
    pair = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    found = F.coalesce(F.when(a == b, a), *[F.when(pair(x, y), F.lit(z)) for x, y, z in special])
    return F.struct(F.when(found.isNotNull(), "exact").otherwise("disagreement").alias("status"), F.coalesce(found, a).alias("value"))


def vocabulary(text: Column, known: dict[str, str]) -> Column:
    """(key, id, review) of a label in a controlled vocabulary; unknown labels are to be reviewed."""
    key = F.trim(F.regexp_replace(F.replace(F.regexp_replace(squash(F.coalesce(text, F.lit(""))), r"[^\w\s&-]", ""), F.lit("&"), F.lit(" and ")), r"\s+", " "))
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv]), key)
    return F.struct(key.alias("key"), F.coalesce(found, F.lit("unknown")).alias("id"), found.isNull().alias("review"))


def mentions_fee(text: Column, phrases: tuple[str, ...] = ("($)", "fee associated", "fees may apply")) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, p: a | low.contains(p), phrases, F.lit(False))


def letter_share(text: Column) -> Column:
    """The share of characters that are ASCII letters or digits; null for empty texts."""
    return share(F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")), F.nullif(F.length(text), F.lit(0)))


def _decomposed() -> tuple[str, str]:
    """Latin letters with marks, and the ASCII letters they are written on."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, base) for c, base in pairs if base != c and base.isascii()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


MARKED, PLAIN = _decomposed()


def folded_slug(text: Column) -> Column:
    """A slug after compatibility decomposition: marks part words as other characters do (crème is cre-me)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    apart = F.translate(F.regexp_replace(low, f"([{MARKED}])", "$1-"), MARKED, PLAIN)
    return F.regexp_replace(F.regexp_replace(apart, "[^a-z0-9]+", "-"), "^-|-$", "")


def ends_with_words(a: Column, b: Column, least: int = 2) -> Column:
    """Whether the shorter text's words, two at least, end the longer's."""
    x, y = (F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "") for c in (a, b))
    short, long_ = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    n = F.size(short)
    return F.when(n < least, F.lit(False)).otherwise(F.slice(long_, F.size(long_) - n + 1, n) == short)
