"""Likeness of texts by matching blocks, and whether a source's words support a title or a field, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.schedules import once
from millrace.functions.titles import scanned_words


def _longest_block(a: Column, b: Column) -> Column:
    """(n, i, j): the longest common substring of two texts that aren't empty, first in ``a``, then in ``b``; n = 0 if there is none.

    If a substring of some length is common, so is one of each lesser length: the length is found by halving.
    """
    least = F.least(F.char_length(a), F.char_length(b))
    places = lambda n: F.sequence(F.lit(1), F.char_length(a) - n + 1)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        held = (s["hi"] - s["lo"] > 1) & F.exists(places(middle), lambda i: F.contains(b, F.substr(a, i, middle)))
        return once(F.struct(middle.alias("m"), held.alias("held")), lambda x: F.struct(F.when(x["held"], x["m"]).otherwise(s["lo"]).alias("lo"), F.when(x["held"], s["hi"]).otherwise(F.greatest(x["m"], s["lo"] + 1)).alias("hi")))

    steps = F.sequence(F.lit(1), F.char_length(F.bin(least)) + 1)
    n = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), (least + 1).alias("hi")), halve, lambda s: s["lo"])

    def placed(n: Column) -> Column:
        i = F.get(F.filter(places(n), lambda i: F.contains(b, F.substr(a, i, n))), 0)
        return once(i, lambda i: F.struct(n.alias("n"), i.alias("i"), F.position(F.substr(a, i, n), b).alias("j")))

    return once(n, placed)


def matched_characters(a: Column, b: Column) -> Column:
    """How many characters the matching blocks of two texts hold, after Ratcliff and Obershelp.

    The longest common substring, then the same on what lies left and right of it in both, level by level until nothing is open.
    """
    pair = "array<struct<a:string,b:string>>"
    full = lambda p: (p["a"] != "") & (p["b"] != "")

    def level(s: Column, _: Column) -> Column:
        def split(p: Column) -> Column:
            def sides(m: Column) -> Column:
                left = F.struct(F.substr(p["a"], F.lit(1), m["i"] - 1).alias("a"), F.substr(p["b"], F.lit(1), m["j"] - 1).alias("b"))
                right = F.struct(F.substr(p["a"], m["i"] + m["n"]).alias("a"), F.substr(p["b"], m["j"] + m["n"]).alias("b"))
                return F.struct(m["n"].alias("n"), F.when(m["n"] > 0, F.filter(F.array(left, right), full)).otherwise(F.array().cast(pair)).alias("open"))

            return once(_longest_block(p["a"], p["b"]), sides)

        def total(parts: Column) -> Column:
            n = F.aggregate(parts, s["n"], lambda t, p: t + p["n"])
            return F.struct(F.flatten(F.transform(parts, lambda p: p["open"])).alias("open"), n.alias("n"))

        return F.when(F.size(s["open"]) == 0, s).otherwise(once(F.transform(s["open"], split), total))

    def whole(p: Column) -> Column:
        first = F.filter(F.array(p), full)
        levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.char_length(p["a"]), F.char_length(p["b"]))))
        return F.aggregate(levels, F.struct(first.cast(pair).alias("open"), F.lit(0).alias("n")), level, lambda s: s["n"])

    return once(F.struct(a.alias("a"), b.alias("b")), whole)


def ratio(a: Column, b: Column) -> Column:
    """Twice the matched characters over all characters: 1 for equal texts (two empty ones included); null if either is null.

    All characters count, however frequent. Which text comes first can matter.
    """

    def of(p: Column) -> Column:
        total = F.char_length(p["a"]) + F.char_length(p["b"])
        return F.when(p["a"] == p["b"], 1.0).when(p["a"].isNotNull() & p["b"].isNotNull(), 2.0 * matched_characters(p["a"], p["b"]) / total)

    return once(F.struct(a.alias("a"), b.alias("b")), of)


def plain_words(text: Column) -> Column:
    """Lower-case letters and digits, words apart by one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def looks_fragmented(words: Column) -> Column:
    """Whether scanned words are in shreds: a third or more of one or two letters, or three and more with a single letter among them."""
    short = F.size(F.filter(words, lambda w: F.length(w) <= 2))
    return F.coalesce((F.size(words) > 0) & ((short * 3 >= F.size(words)) | ((F.size(words) >= 3) & F.exists(words, lambda w: F.length(w) == 1))), F.lit(False))


def _near(x: Column, y: Column, least: float) -> Column:
    """One holds the other, or the ratio is ``least`` or more; false if either is empty."""
    long_enough = 2 * F.least(F.length(x), F.length(y)) >= least * (F.length(x) + F.length(y))
    return F.when((x == "") | (y == ""), False).when(F.contains(x, y) | F.contains(y, x), True).when(~long_enough, False).otherwise(ratio(x, y) >= least)


def supports_title(title: Column, span: Column, least: float = 0.92) -> Column:
    """Whether a scanned span supports a title: it has all its words; or, if the span is in shreds (or has | or +), their letters hold each other or are alike."""

    def held(p: Column) -> Column:
        shreds = looks_fragmented(p["s"]) | F.coalesce(span.rlike(r"[|+]"), F.lit(False))
        close = _near(F.array_join(p["t"], ""), F.array_join(p["s"], ""), least)
        return F.when((F.size(p["t"]) == 0) | (F.size(p["s"]) == 0), False).when(F.size(F.array_except(p["t"], p["s"])) == 0, True).when(shreds, close).otherwise(False)

    empty = F.lit("")
    return once(F.struct(scanned_words(F.coalesce(title, empty)).alias("t"), scanned_words(F.coalesce(span, empty)).alias("s")), held)


def supports_field(value: Column, span: Column, least: float = 0.82) -> Column:
    """Whether a scanned span supports a field's value: their letters and digits hold each other or are alike."""
    compact = lambda c: F.array_join(scanned_words(F.coalesce(c, F.lit(""))), "")
    return once(F.struct(compact(value).alias("v"), compact(span).alias("s")), lambda p: _near(p["v"], p["s"], least))
