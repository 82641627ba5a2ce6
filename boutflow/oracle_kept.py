"""SQL with the rows of the queries of ``queries_kept``: what the kept tables hold in the end, counted from scratch."""

from __future__ import annotations

from boutflow.oracle import _ISSUES, SQL, _counter
from boutflow.oracle_store import _AS_OF, _MORE

_KEPT = f"""WITH {_MORE}, kept AS (
  SELECT competitor_id, year, bout_id, country, participants,
         CASE WHEN competitor_id % 3 = 0 AND bout_id % 4 = 1 AND NOT (year = 2000 AND competitor_id % 2 = 0) THEN 'NEW ' || org ELSE org END AS org
  FROM listings WHERE NOT (year = 2000 AND competitor_id % 2 <> 0 AND competitor_id % 3 <> 0 AND bout_id % 2 <> 0)
), kept_names AS (
  SELECT u.competitor_id, u.year, u.name_used FROM names_used AS u JOIN kept AS k ON u.competitor_id = k.competitor_id AND u.bout_id = k.bout_id
), kept_edges AS (
  SELECT competitor_id AS src, t.id AS dst, year, count(*) AS n_bouts FROM kept AS k JOIN taking AS t USING (bout_id) WHERE t.id <> competitor_id GROUP BY ALL
)
"""
_CARDS = f"""WITH {_MORE}, cards AS (
  SELECT bout_id, bout_date, is_victory, bout_id % 50 AS n, s0, s1, bout_id % 3 + 1 AS version,
         CASE WHEN bout_id % 4 = 0 AND len(participants) >= 3 THEN [[participants[1]], [participants[2]], participants[3:]] ELSE [s0, s1] END AS raw
  FROM bouts
), read AS (
  SELECT *, n NOT BETWEEN 7 AND 11 AS good, [list_sort([CASE WHEN x % 10 = 0 THEN -1 ELSE x END FOR x IN s]) FOR s IN raw] AS now,
         len([1 FOR s IN raw IF len(s) = 2 AND len([1 FOR x IN s IF x % 10 <> 0]) = 2 AND list_sum(s) % 3 = 1]) AS teams
  FROM cards
)
"""


def _rollup(rows: str, edges: str, names: str) -> str:
    return f"""SELECT b.competitor_id, b.year, b.n_bouts, coalesce(o.n_opponents, 0) AS n_opponents, coalesce(o.opponents, '') AS opponents, coalesce(co.c, '') AS countries, coalesce(og.c, '') AS orgs{", coalesce(nm.c, '') AS names" if names else ""}
FROM (SELECT competitor_id, year, count(*) AS n_bouts FROM {rows} GROUP BY ALL) AS b
LEFT JOIN (SELECT src, year, count(*) AS n_opponents, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY n_bouts DESC, dst) AS opponents FROM {edges} GROUP BY ALL) AS o ON b.competitor_id = o.src AND b.year = o.year
LEFT JOIN {_counter(rows, "country")} AS co ON b.competitor_id = co.competitor_id AND b.year = co.year
LEFT JOIN {_counter(rows, "org")} AS og ON b.competitor_id = og.competitor_id AND b.year = og.year
""" + (f"LEFT JOIN {_counter(names, 'name_used')} AS nm ON b.competitor_id = nm.competitor_id AND b.year = nm.year" if names else "")


def _with_examples(rows: str, by: str, key: str, n: str = "n") -> str:
    """Of rows (``by``, found, ``key``): the number found, and the three smallest keys."""
    return f"""SELECT {by}, count(*) FILTER (WHERE found) AS {n}, coalesce(string_agg(CAST({key} AS VARCHAR), ',' ORDER BY {key}) FILTER (WHERE found AND k <= 3), '') AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY {by}, found ORDER BY {key}) AS k FROM ({rows})) GROUP BY {by}"""


_KINDS = {
    "all": "true", "reparsed": "good", "parse_error": "NOT good", "missing_sides": "version = 1", "newly_multi_sided": "good AND len(now) > 2", "side_differences": "good AND version <> 1 AND now <> [s0, s1]",
}

SQL |= {
    "kept_rollup": _KEPT + _rollup("kept", "kept_edges", "kept_names"),
    "kept_edges": _KEPT + """SELECT competitor_id AS src, t.id AS dst, year, count(*) AS n_bouts FROM kept AS k JOIN taking AS t USING (bout_id)
WHERE t.id <> competitor_id AND NOT (year = 1999 AND competitor_id % 5 = 1 AND bout_id % 3 = 0) GROUP BY ALL""",
    "edges_of_one": _KEPT + "SELECT 'from' AS direction, * FROM kept_edges WHERE src = 7 UNION ALL SELECT 'to', * FROM kept_edges WHERE dst = 7",
    "streamed_rollup": f"""WITH {_MORE}, paged AS (
  SELECT bout_id, year, CASE WHEN bout_id % 3 = 0 THEN 'Elsewhere' ELSE country END AS country, CAST(org_id AS VARCHAR) AS org, list_distinct(list_concat(p0, p1)) AS people
  FROM shown JOIN organisations USING (org)
), owned AS (
  SELECT * FROM (SELECT *, unnest(people) AS competitor_id FROM paged) WHERE competitor_id > 0
), met AS (
  SELECT competitor_id AS src, dst, year, count(*) AS n_bouts FROM (SELECT *, unnest(people) AS dst FROM owned) WHERE dst <> competitor_id GROUP BY ALL
) """ + _rollup("owned", "met", ""),
    "indexed_search": f"""WITH {_MORE} SELECT text, CAST(row_number() OVER (PARTITION BY text ORDER BY lower(name) <> text, name, competitor_id) AS INTEGER) AS rank, competitor_id, name
FROM (SELECT DISTINCT lower(right(name, 3)) AS text FROM competitors WHERE competitor_id % 10 = 3) JOIN competitors ON contains(lower(name), text)
QUALIFY row_number() OVER (PARTITION BY text ORDER BY lower(name) <> text, name, competitor_id) <= 20""",
    "filled_column": f"""WITH {_MORE} SELECT competitor_id, CAST(CASE WHEN competitor_id % 11 <> 0 AND competitor_id % 13 <> 0 AND competitor_id % 7 = 0 THEN 1996 END AS INTEGER) AS career_end,
CAST(CASE WHEN competitor_id % 3 = 1 THEN 3 ELSE 2 END AS INTEGER) AS generation FROM competitors""",
    "stored_predictions": f"""WITH {_MORE} SELECT subject_id, CASE WHEN kept THEN 0.125 ELSE confidence END AS confidence, {_AS_OF} - CASE WHEN kept THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS made_at,
CAST(CASE WHEN kept AND tenth = 3 THEN 0 ELSE 1 END AS INTEGER) AS version
FROM (SELECT *, subject_id // 10 % 4 AS tenth, subject_id // 10 % 4 = 2 OR subject_id % 30 = 0 AS kept FROM guessed) WHERE NOT (subject_id % 30 = 0 AND tenth IN (0, 1))""",
    "card_bouts": _CARDS + """SELECT bout_id AS page_id, CAST(3 AS INTEGER) AS version, bout_date, is_victory, CAST(len(now) AS INTEGER) AS n_sides, array_to_string([array_to_string(s, ',') FOR s IN now], '|') AS sides,
CASE WHEN len(now) > 2 THEN 'multi_way' WHEN len(now[1]) = 1 AND len(now[2]) = 1 THEN 'singles' WHEN len(now[1]) = 2 AND len(now[2]) = 2 THEN 'tag_team' ELSE 'other_two_sided' END AS type, CAST(teams AS INTEGER) AS n_teams FROM read WHERE good""",
    "parse_errors": _CARDS + _with_examples("SELECT ['no markup', 'no row', 'no card', 'no participant', 'no date'][n - 6] AS error, bout_id AS page_id, true AS found FROM read WHERE NOT good", "error", "page_id", "n_pages"),
    "reparsed_cards": _CARDS + _with_examples(
        " UNION ALL ".join(f"SELECT '{k}' AS kind, bout_id, {e} AS found FROM read" for k, e in _KINDS.items()) + " UNION ALL SELECT 'version ' || version || ' to 3', bout_id, true FROM read WHERE good AND version < 3", "kind", "bout_id"
    ),
    "issue_examples": f"WITH {_MORE} " + _with_examples(" UNION ALL ".join(f"SELECT '{n}' AS issue, bout_id, {e} AS found FROM bouts" for n, e in _ISSUES.items()), "issue", "bout_id", "n_bouts"),
}
