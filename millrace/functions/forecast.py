"""Forecast rules as Column expressions: units, risks, advice on timing and states of items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import temporal


def celsius(fahrenheit: Column) -> Column:
    return F.round((fahrenheit - 32) * 5 / 9, 1)


def kilometres(miles: Column) -> Column:
    return F.round(miles * 1.609344, 1)


def first_number(text: Column) -> Column:
    """The first number of a text such as "10 to 15 mph"; null if there is none."""
    return F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def rain_signal(starts_in: Column, rain: Column, thunder: Column, amount: Column, told: Column, severe: Column) -> Column:
    """storm_alert, likely, possible, unlikely or unknown, for what starts within two hours, from the greatest values in its window."""
    return (
        F.when((starts_in < 0) | (starts_in > 120), "unknown")
        .when(severe, "storm_alert")
        .when(rain.isNull() & thunder.isNull() & amount.isNull() & ~told, "unknown")
        .when((F.coalesce(rain, F.lit(0)) >= 60) | (F.coalesce(thunder, F.lit(0)) >= 40) | (F.coalesce(amount, F.lit(0.0)) >= 2.5), "likely")
        .when((F.coalesce(rain, F.lit(0)) >= 30) | (F.coalesce(thunder, F.lit(0)) >= 20) | told, "possible")
        .otherwise("unlikely")
    )


def timing_advice(hours_out: Column, flexible: Column, long_range: Column, now_pct: Column, earlier_pct: Column, drier: int = 20, limit: int = 72) -> Column:
    """(allowed, advice): none for the past and fixed times, soft planning beyond the limit, go earlier if that is so many points drier."""
    give = lambda ok, what: F.struct(F.lit(ok).alias("allowed"), F.lit(what).cast("string").alias("advice"))
    return (
        F.when((hours_out < 0) | ~flexible, give(False, None))
        .when(long_range | (hours_out > limit), give(False, "soft_planning_only"))
        .when(F.coalesce(now_pct - earlier_pct >= drier, F.lit(False)), give(True, "go_earlier"))
        .otherwise(give(True, "keep_time"))
    )


def storm_state(severities: Column, urgencies: Column, risk: Column) -> Column:
    """danger for a severe or immediate alert, caution for a high risk, else none."""
    severe = F.exists(severities, lambda s: s.isin("Extreme", "Severe")) | F.exists(urgencies, lambda u: u == "Immediate")
    return F.when(F.coalesce(severe, F.lit(False)), "danger").when(risk == "high", "caution").otherwise("none")


def effective_start(start: Column, end: Column, now: Column) -> Column:
    """What is under way counts from now."""
    return F.when((start < now) & (end >= now), now).otherwise(start)


#: How much modes suffer from rain and wind: (exposed, stops in storms).
EXPOSED = {"walk": (True, False), "boat": (True, True), "skyliner": (True, True), "monorail": (False, False), "bus": (False, False)}


def route_impact(mode: Column, risk: Column) -> Column:
    """stop, slow or none for a mode of travel under a risk (low, moderate, high)."""
    exposed, stops = (mode.isin(*[m for m, v in EXPOSED.items() if v[k]]) for k in (0, 1))
    return F.when((risk == "high") & stops, "stop").when(((risk == "high") | (risk == "moderate")) & exposed, "slow").when(risk == "high", "slow").otherwise("none")


def proximity(entity: Column, home: Column, cluster: Column, home_cluster: Column, linked: Column) -> Column:
    """here, same_area, one_ride or far."""
    return F.when(entity == home, "here").when(F.coalesce(cluster == home_cluster, F.lit(False)), "same_area").when(F.coalesce(linked, F.lit(False)), "one_ride").otherwise("far")


def living_state(changed: Column, start: Column, end: Column, verified: Column, now: Column) -> Column:
    """changed, now (between start and end), soon (within 90 minutes), verified (within 14 days) or null, by the first that fits."""
    to_start = temporal.seconds_apart(now, start)
    return (
        F.when(F.coalesce(changed, F.lit(False)), "changed")
        .when((start <= now) & (now < end), "now")
        .when((to_start > 0) & (to_start <= 5400), "soon")
        .when((verified <= now) & (temporal.seconds_apart(verified, now) <= 14 * 86400), "verified")
    )


def risk_level(rain: Column, wind: Column, heat: Column) -> Column:
    """high, moderate or low by the worst of three measures."""
    return F.when((rain >= 70) | (wind >= 35) | (heat >= 105), "high").when((rain >= 40) | (wind >= 20) | (heat >= 95), "moderate").otherwise("low")


#: Where a trust state goes for each quality tier.
DOWNGRADES = {("verified", "low"): "unverified", ("verified", "review"): "needs_check", ("verified", "hidden"): "hidden", ("likely", "low"): "unverified", ("likely", "hidden"): "hidden", ("unverified", "hidden"): "hidden"}


def trust_state(base: Column, tier: Column) -> Column:
    """The base state, downgraded by the tier's entry in the matrix."""
    table = F.create_map(*[F.lit(x) for (b, t), v in sorted(DOWNGRADES.items()) for x in (f"{b}/{t}", v)])
    return F.coalesce(F.try_element_at(table, F.concat(base, F.lit("/"), tier)), base)


def base_trust(verified_days: Column, evidence: Column, disputed: Column, recent: int = 7) -> Column:
    """needs_check if disputed; verified with evidence not older than so many days; likely with evidence; else unverified."""
    return F.when(disputed, "needs_check").when(evidence & (verified_days <= recent), "verified").when(evidence, "likely").otherwise("unverified")


def fee_verdict(title_fee: Column, body_fee: Column, body_free: Column, may_set_price: Column) -> Column:
    """(fee, review): a fee if title or body say so, free if only the body says free; both at once, or a source that may not set prices, is to be reviewed."""
    fee = title_fee | body_fee
    said = F.when(fee & ~body_free, True).when(body_free & ~fee, False)
    return F.struct(F.when(may_set_price, said).alias("fee"), ((fee & body_free) | (said.isNotNull() & ~may_set_price)).alias("review"))
