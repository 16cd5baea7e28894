"""Search scores, typo tolerance and trigram similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def typo_allowance(word: Column) -> Column:
    """0 below 4 characters, 1 up to 6, then 2."""
    n = F.length(word)
    return F.when(n < 4, 0).when(n <= 6, 1).otherwise(2)


def one_swap(a: Column, b: Column) -> Column:
    """Whether one exchange of two neighbouring characters turns a into b."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swapped = lambda k: F.concat(F.substring(a, F.lit(1), k - 1), F.substring(a, k + 1, F.lit(1)), F.substring(a, k, F.lit(1)), F.substring(a, k + 2, F.length(a)))
    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & (a != b) & F.exists(places, lambda k: swapped(k) == b)


def typo_distance(a: Column, b: Column, most: Column) -> Column:
    """Edits from a to b, a swap of neighbours as the whole difference counting 1; null above ``most``."""
    d = F.when(one_swap(a, b), 1).otherwise(F.levenshtein(a, b))
    return F.when(d <= most, d)


def field_score(query: Column, field: Column, weight: float) -> Column:
    """A field's score for a one-word query: equal 1, prefix .92, inside .82, a word of it .42, a typo .28 per edit; times the weight."""
    words = F.filter(F.split(field, "[^a-z0-9]+"), lambda w: w != "")
    allowed = typo_allowance(query)
    nearest = F.array_min(F.transform(words, lambda w: typo_distance(query, w, allowed)))
    part = (
        F.when(field == query, 1.0)
        .when(F.startswith(field, query), 0.92)
        .when(F.contains(field, query), 0.82)
        .when(F.exists(F.split(query, " "), lambda t: F.array_contains(words, t)), 0.42)
        .when(nearest > 0, 0.28 / nearest)
        .otherwise(0.0)
    )
    return part * weight


def phrase_score(words: Column, text: Column, weight: float) -> Column:
    """The share of the words found in the text, times the weight; 0 for no words."""
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return F.when(F.size(words) == 0, 0.0).otherwise(hits * F.lit(weight) / F.size(words))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a padded lower-case text."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda k: F.substring(padded, k, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)
