"""Counters as text, labels and markup helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def counter_text(pairs: Column) -> Column:
    """An array of (key, n) as ``key=n`` joined by commas, in order of the key."""
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: F.concat(p["key"].cast("string"), F.lit("="), p["n"].cast("string"))), ",")


def record_text(wins: Column, losses: Column, draws: Column) -> Column:
    """``W-L``, or ``W-L-D`` with draws."""
    return F.when(draws > 0, F.concat_ws("-", wins, losses, draws)).otherwise(F.concat_ws("-", wins, losses))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "very high").when(confidence >= 0.75, "high").when(confidence >= 0.5, "moderate").when(confidence >= 0.3, "low").otherwise("very low")


def bout_type(sides: Column) -> Column:
    """singles, tag_team, other_two_sided, multi_way or unknown, from the sides' sizes."""
    return (
        F.when(F.size(sides) > 2, "multi_way")
        .when(F.size(sides) != 2, "unknown")
        .when(F.forall(sides, lambda s: F.size(s) == 1), "singles")
        .when(F.forall(sides, lambda s: F.size(s) == 2), "tag_team")
        .otherwise("other_two_sided")
    )


def is_proxy_org(name: Column) -> Column:
    """Organisations that stand for free-lance shows of a country."""
    # fixed value: the name pattern
    return name.rlike("(?i)^Wrestling In (.+) - Freelance Shows")


def trimmed_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), "^[:\\s]+|[:\\s]+$", ""))


def venue_country(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """The country (fixed values: the kinds of event) at the end of ``<kind of event> @ place, region, country``; Unknown without one."""
    place = F.regexp_extract(text, r"(?:Event|Online Stream|TV-Show|Pay Per View|Dark Match|House Show) @ (.+)$", 1)
    last = F.trim(F.regexp_replace(F.trim(F.element_at(F.split(place, ","), -1)), r"\.$", ""))
    if aliases:
        known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        last = F.coalesce(known[last], last)
    return F.regexp_replace(last, r"\A\z", "Unknown")


def link_kind(href: Column) -> Column:
    """Kinds of links by their query id."""
    number = F.regexp_extract(href, r"(?:[?&]|&amp;)id=(\d+)", 1)
    kinds = {"2": "competitor", "8": "organisation", "1": "event", "28": "tag_team", "29": "stable"}
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(known[number], F.lit("other"))
