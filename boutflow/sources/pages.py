"""Landed pages to facts and bouts.

``facts`` reads titles, links and labelled values off any page with built-in functions. ``bouts`` reads the
rows of a bout list: the markup of a row becomes an array of tokens, and a fold over the array gives the
sides, so no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutflow.functions.dates import first_date
from boutflow.functions.text import link_kind, venue_country


def plain(text: Column) -> Column:
    """Text of markup: tags out, the common entities back, white space as one space."""
    out = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def titles(pages: DataFrame) -> DataFrame:
    """page_id, title, language."""
    title = F.nullif(plain(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    lang = F.nullif(F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1), F.lit(""))
    return pages.select("page_id", title.alias("title"), lang.alias("language"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, position, href, text, kind, number (the query's ``nr``)."""
    anchor = r'<a href="([^"]*)"[^>]*>([^<]*)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("text"))
    rows = pages.select("page_id", F.posexplode(pairs).alias("position", "l"))
    text = F.coalesce(F.nullif(F.trim(F.col("l.text")), F.lit("")), F.lit("Unknown"))
    number = F.regexp_extract("l.href", r"(?:[?&]|&amp;)nr=(\d+)", 1).try_cast("long")
    return rows.select("page_id", "position", F.col("l.href").alias("href"), text.alias("text"), link_kind(F.col("l.href")).alias("kind"), number.alias("number"))


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, and the query's parameters, a row each (none: one row with nulls)."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.explode_outer(pairs).alias("pair"))
    return rows.select("page_id", "host", "path", F.regexp_extract("pair", r"^([^=]*)", 1).alias("parameter"), F.regexp_extract("pair", r"=(.*)$", 1).alias("value"))


def labelled(pages: DataFrame) -> DataFrame:
    """page_id, profile: labels and values of ``<div class="Label">``/``<div class="Value">`` pairs as a map."""
    row = r'(?is)<div class="[^"]*BoxTitle[^"]*">(.*?)</div>\s*<div class="[^"]*BoxContents[^"]*">(.*?)</div>'
    label = lambda x: F.trim(F.regexp_replace(plain(x), r":\s*$", ""))
    keys = F.transform(F.regexp_extract_all("html", F.lit(row), F.lit(1)), label)
    values = F.transform(F.regexp_extract_all("html", F.lit(row), F.lit(2)), plain)
    entries = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"] != "")
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda p: p["k"] == e["k"]))
    return pages.select("page_id", F.map_from_entries(first).alias("profile"))


def year_options(pages: DataFrame) -> DataFrame:
    """page_id, years: the numeric options of a selector."""
    return pages.select("page_id", F.transform(F.array_distinct(F.regexp_extract_all("html", F.lit(r'<option value="(\d+)"'), F.lit(1))), lambda y: y.cast("int")).alias("years"))


def profile_name(profile: Column, override: Column | None = None) -> Column:
    """Override, current gimmick, page name, or the first alter ego (before ``a.k.a.``); else Unknown."""
    ego = F.nullif(F.trim(F.element_at(F.split(F.split(profile["Alter egos"], r"a\.k\.a\.")[0], ","), 1)), F.lit(""))
    known = [F.nullif(F.trim(profile[k]), F.lit("")) for k in ("Current gimmick", "Name")]
    return F.coalesce(*([override] if override is not None else []), *known, ego, F.lit("Unknown"))


def in_cohort(profile: Column, competitor_id: Column, overrides: tuple[int, ...] = ()) -> Column:
    return competitor_id.isin(*overrides) | F.coalesce(F.lower(profile["Gender"]) == "female", F.lit(False))


def organisation(profile: Column) -> Column:
    """name, founded (before the dash) and country (last part of the location)."""
    founded = F.trim(F.split(profile["Active Time"], " - ")[0])
    return F.struct(F.coalesce(profile["Name"], profile["Current name"]).alias("name"), founded.alias("founded"), F.trim(F.element_at(F.split(profile["Location"], ","), -1)).alias("country"))


_MARK = "\u0001"


def tokens(card: Column) -> Column:
    """The markup of a bout card as an array of (kind, id, text).

    Kinds: competitor, team, open, close, and, amp, versus, defeat, text.
    """
    marked = F.regexp_replace(card, r'(<a href="[^"]*"[^>]*>[^<]*</a>|[()]|&amp;|\bvs\.|\bdefeats?\b|\band\b)', f"{_MARK}$1{_MARK}")
    shown = lambda p: F.when(p.startswith("<a ") | p.isin("", "(", ")", "and", "vs.", "defeat", "defeats"), p).when(p == " ", "").when(p == "&amp;", "&").otherwise(plain(p))  # noqa: E731  most parts need no cleaning
    parts = F.filter(F.transform(F.split(marked, _MARK), shown), lambda p: p != "")
    constants = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    of_link = constants({"2": "competitor", "28": "team", "29": "team"})  # by the id of the href's query, as in ``link_kind``
    of_text = constants({"(": "open", ")": "close", "&": "amp", "and": "and", "vs.": "versus", "defeat": "defeat", "defeats": "defeat"})
    first = r'(?s)\A(?:(?!href=").)*href="(?=[^"]*")[^"]*?(?:[?&]|&amp;)%s=(\d+)'  # within the first href

    def classify(p: Column) -> Column:
        linked = p.startswith("<a ")
        kind = F.coalesce(F.when(linked, of_link[F.regexp_extract(p, first % "id", 1)]).otherwise(of_text[p]), F.lit("text"))
        number = F.when(linked, F.regexp_extract(p, first % "nr", 1).try_cast("long"))
        return F.struct(kind.alias("kind"), number.alias("id"), F.when(linked, F.regexp_extract(p, r">([^<]*)</a>", 1)).otherwise(p).alias("text"))

    return F.transform(parts, classify)


def fold_sides(found: Column) -> Column:
    """Sides and victory of an array of tokens.

    ``&`` stays on the side; ``vs.`` outside parentheses, ``defeats``, and ``and`` outside parentheses after a
    victory start one; text is an unlinked participant (-1) only where one is expected and it is short.
    """
    empty = F.array().cast("array<bigint>")
    start = F.struct(F.array().cast("array<array<bigint>>").alias("sides"), empty.alias("now"), F.lit(False).alias("victory"), F.lit(0).alias("depth"), F.lit(True).alias("expects"))

    def step(s: Column, t: Column) -> Column:
        kind = t["kind"]
        turn = ((kind == "versus") & (s["depth"] == 0)) | (kind == "defeat") | ((kind == "and") & s["victory"] & (s["depth"] == 0))
        stranger = (kind == "text") & s["expects"] & (F.length(t["text"]) < 50) & ~t["text"].startswith("-")
        person = F.when(kind == "competitor", t["id"]).when(stranger, F.lit(-1).cast("long"))
        separator = kind.isin("versus", "defeat", "and", "amp")
        return F.struct(
            F.when(turn & (F.size(s["now"]) > 0), F.array_append(s["sides"], F.sort_array(s["now"]))).otherwise(s["sides"]).alias("sides"),
            F.when(turn, empty).when(person.isNotNull(), F.array_append(s["now"], person)).otherwise(s["now"]).alias("now"),
            (s["victory"] | (kind == "defeat")).alias("victory"),
            (s["depth"] + F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)).alias("depth"),
            F.when(separator, True).when(person.isNotNull() | (kind == "team"), False).otherwise(s["expects"]).alias("expects"),
        )

    def finish(s: Column) -> Column:
        sides = F.when(F.size(s["now"]) > 0, F.array_append(s["sides"], F.sort_array(s["now"]))).otherwise(s["sides"])
        return F.struct(sides.alias("sides"), s["victory"].alias("is_victory"))

    return F.aggregate(found, start, step, finish)


#: The version of bouts that this parser makes.
PARSE_VERSION = 3
_TABLE_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"


def _span(row: Column | str, name: str) -> Column:
    return F.regexp_extract(row, rf'(?is)<(span|div) class="{name}">(.*?)</\1>', 2)


def bouts(pages: DataFrame) -> DataFrame:
    """page_id, position, bout_date, bout_type, country, org_id, sides, is_victory, participants, teams of two linked members."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_TABLE_ROW), F.lit(1))).alias("position", "row"))
    return _described(rows.withColumn("card", _span("row", "MatchCard")).where("card <> ''"), ["page_id"])


def parsed(pages: DataFrame) -> DataFrame:
    """A row for each bout of a page, with what ``bouts`` has, its ``version``, and ``error``; other columns of ``pages`` but the markup stay.

    A page that gives no bout has one row with an error: no markup, no row, no card. A bout that can't be
    stored has one too: no participant, no date.
    """
    keep = [c for c in pages.columns if c != "html"]
    found = pages.select(*keep, (F.coalesce(F.trim("html"), F.lit("")) == "").alias("blank"), F.regexp_extract_all("html", F.lit(_TABLE_ROW), F.lit(1)).alias("found"))
    carded = F.transform("found", lambda row, k: F.struct(k.alias("position"), row.alias("row"), _span(row, "MatchCard").alias("card")))
    read = found.select(*keep, "blank", (F.size("found") == 0).alias("no_row"), F.filter(carded, lambda c: c["card"] != "").alias("cards"))  # a step each, so that none is done twice
    state = F.when(F.col("blank"), "no markup").when(F.col("no_row"), "no row").when(F.size("cards") == 0, "no card")
    rows = read.select(*keep, state.alias("error"), F.explode_outer("cards").alias("c")).select(*keep, "error", "c.*")
    out = _described(rows, [*keep, "error"])
    error = F.coalesce("error", F.when(F.size("participants") <= 0, "no participant").when(F.col("bout_date").isNull(), "no date"))
    return out.withColumns({"error": error, "version": F.lit(PARSE_VERSION)})


def _described(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, position and the fields of a bout, of rows of markup (``row``) with their ``card``."""
    read = rows.withColumn("parsed", fold_sides(tokens(F.col("card"))))
    team = r'(?s)<a href="[^"]*[?&]id=(28|29)&(?:amp;)?nr=(\d+)[^"]*"[^>]*>([^<]*)</a>\s*\((.*?)\)'
    whole = F.regexp_extract_all("card", F.lit(team), F.lit(0))
    member = r"[?&]id=2&(?:amp;)?nr=(\d+)"
    teams = F.filter(
        F.transform(whole, lambda w: F.struct(F.regexp_extract(w, team, 2).cast("long").alias("team_id"), F.regexp_extract(w, team, 3).alias("name"), F.when(F.regexp_extract(w, team, 1) == "28", "tag_team").otherwise("stable").alias("kind"), F.sort_array(F.transform(F.regexp_extract_all(w, F.lit(member), F.lit(1)), lambda m: m.cast("long"))).alias("members"))),
        lambda t: F.size(t["members"]) == 2,
    )
    event = _span("row", "MatchEventLine")
    return read.select(
        *keep, "position", first_date(F.regexp_replace("row", r"<[^>]*>", " ")).alias("bout_date"), F.nullif(F.regexp_replace(plain(_span("row", "MatchType")), r":\s*$", ""), F.lit("")).alias("bout_type"), venue_country(plain(event)).alias("country"),
        F.regexp_extract("row", r"[?&]id=8&(?:amp;)?nr=(\d+)", 1).try_cast("long").alias("org_id"), "parsed.sides", "parsed.is_victory",
        F.sort_array(F.array_distinct(F.flatten("parsed.sides"))).alias("participants"), teams.alias("teams"),
    )
