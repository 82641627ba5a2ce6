"""SQL with the rows of the queries of ``queries_store``."""

from __future__ import annotations

from boutflow.oracle import SQL, _BASE, _plan

_MORE = (
    _BASE
    + """, facts AS (
  SELECT competitor_id, CASE WHEN blank THEN 'Unknown' WHEN competitor_id % 3 = 0 THEN 'G ' || name ELSE name END AS name, NOT blank AND NOT diverse AND in_cohort AS in_cohort, NOT blank AND diverse AS diverse,
         CASE WHEN blank OR competitor_id % 4 = 0 THEN 'Freelancer' ELSE (['AUTOMOBILE', 'BLD', 'FUR', 'HOUSEHOLD', 'MCH'])[competitor_id % 5 + 1] END AS org,
         CASE WHEN NOT blank THEN CAST(year(start) AS INTEGER) END AS career_start, CASE WHEN NOT blank AND competitor_id % 7 = 0 THEN 1996 END AS career_end, CASE WHEN NOT blank AND competitor_id % 6 <> 0 THEN country END AS birthplace,
         CASE WHEN NOT blank AND competitor_id % 5 <> 0 THEN start END AS debut, blank
  FROM (SELECT *, competitor_id % 11 = 0 OR competitor_id % 13 = 0 AS blank, DATE '1960-01-01' + CAST(competitor_id * 397 % 11000 AS INTEGER) AS start FROM competitors)
), last_years AS (SELECT competitor_id, max(year) AS last_year, arg_max(primary_org, year) AS org FROM prim GROUP BY 1
), inact AS (
  SELECT competitor_id, last_year, f.career_end IS NOT NULL OR last_year IS NULL OR last_year < 1999 AS inactive FROM facts AS f LEFT JOIN last_years USING (competitor_id)
), natl AS (
  SELECT p.competitor_id, p.competitor_id IN (1, 2, 3) OR m.k = 'NATION_0' OR contains(p.org, 'NATION_0') OR p.org = 'BUILDING' AS at_home FROM last_years AS p
  LEFT JOIN (SELECT * FROM (SELECT competitor_id, country AS k, count(*) AS n FROM listings GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY competitor_id ORDER BY n DESC, k) = 1) AS m USING (competitor_id)
), lists AS (
  SELECT l.*, u.last_updated - (2002 - year) * INTERVAL 50 DAY AS last_updated FROM (SELECT competitor_id, year, count(*) AS n_bouts FROM listings GROUP BY ALL) AS l LEFT JOIN updates AS u USING (competitor_id)
), stubbed AS (
  SELECT competitor_id, year, n_bouts FROM lists UNION ALL
  SELECT competitor_id, CAST(y.year AS INTEGER), 0 FROM competitors AS c CROSS JOIN (SELECT unnest(range(1993, 2003)) AS year) AS y WHERE NOT EXISTS (SELECT 1 FROM lists AS l WHERE l.competitor_id = c.competitor_id AND l.year = y.year)
), fresh AS (SELECT * FROM listings WHERE year = 2000 AND bout_id % 2 = 0
), relisted AS (
  SELECT * FROM listings WHERE (competitor_id, year) NOT IN (SELECT (competitor_id, year) FROM fresh) UNION ALL SELECT * FROM fresh
), fresh_edges AS (
  SELECT competitor_id AS src, t.id AS dst, year, count(*) AS n_bouts FROM fresh AS l JOIN taking AS t ON l.bout_id = t.bout_id WHERE t.id <> competitor_id GROUP BY ALL
), patched AS (
  SELECT d.competitor_id, d.year, d.list_age, l.n_bouts FROM dated AS d JOIN lists AS l USING (competitor_id, year) WHERE d.year < 2002 AND (d.competitor_id % 9 <> 0 OR d.year = 1995)
), patchy AS (
  SELECT * FROM patched UNION ALL
  SELECT competitor_id, CAST(y.year AS INTEGER), CASE WHEN (competitor_id + y.year) % 13 <> 0 THEN (competitor_id * 31 + y.year * 17) % 800 END, 0
  FROM competitors AS c CROSS JOIN (SELECT unnest(range(1990, 2003)) AS year) AS y WHERE (competitor_id + y.year) % 3 = 0 AND NOT EXISTS (SELECT 1 FROM patched AS p WHERE p.competitor_id = c.competitor_id AND p.year = y.year)
), stubs AS (
  SELECT p.competitor_id, count(*) FILTER (WHERE stub) AS n_stubs, count(*) FILTER (WHERE n_bouts > 0) AS n_populated, min(p.year) FILTER (WHERE n_bouts > 0) AS first_year, max(p.year) FILTER (WHERE n_bouts > 0) AS last_year,
         CAST(sum(n_bouts) AS BIGINT) AS n_bouts, coalesce(string_agg(CAST(p.year AS VARCHAR), ',' ORDER BY p.year) FILTER (WHERE stub), '') AS stub_years, any_value(2002 - f.career_start) AS career_length
  FROM (SELECT *, n_bouts = 0 AND (list_age IS NULL OR list_age > 365) AS stub FROM patchy) AS p JOIN competitors AS c USING (competitor_id) JOIN facts AS f USING (competitor_id) WHERE c.in_cohort GROUP BY 1
), home_cohort AS (
  SELECT competitor_id FROM competitors AS c JOIN facts AS f USING (competitor_id)
  WHERE c.in_cohort AND (competitor_id IN (1, 2, 3) OR c.country = 'NATION_0' OR contains(f.org, 'NATION_0') OR f.org = 'BLD' OR competitor_id IN (SELECT competitor_id FROM listings WHERE year = 2001 AND country = 'NATION_0'))
), split AS (
  SELECT competitor_id, year, count(*) AS n_bouts FROM listings WHERE competitor_id % 2 = 0 AND bout_id % 10 <> 7 GROUP BY ALL
), late AS (
  SELECT competitor_id, year, CASE WHEN competitor_id % 9 = 0 THEN 0 ELSE n_bouts END AS n FROM stubbed WHERE competitor_id % 9 <> 0 OR year > 2000
), late_only AS (SELECT competitor_id FROM late GROUP BY 1 HAVING sum(n) = 0 AND bool_and(year IN (2001, 2002))
), shown AS (
  SELECT *, list_sort(list_transform(s0, lambda x: CASE WHEN x % 10 = 0 THEN -1 ELSE x END)) AS p0, list_sort(list_transform(s1, lambda x: CASE WHEN x % 10 = 0 THEN -1 ELSE x END)) AS p1 FROM bouts
), named AS (
  SELECT bout_id, year, list_sum(s) AS total, s FROM (SELECT bout_id, year, unnest([s0, s1]) AS s FROM bouts) WHERE len(s) = 2 AND s[1] % 10 <> 0 AND s[2] % 10 <> 0 AND list_sum(s) % 3 = 0
)
"""
)
_AS_OF = "TIMESTAMP '2024-06-30 00:00:00'"
_AGE = f"(epoch({_AS_OF}) - floor(epoch(last_updated))) / 86400.0"


def _sql(body: str) -> str:
    return f"WITH {_MORE} {body}"


def _counts(table: str, key: str, name: str) -> str:
    return f"SELECT competitor_id, year, '{name}' AS counter, {key} AS key, count(*) AS n FROM {table} GROUP BY ALL"


_JOIN = "array_to_string({}, ',')"

SQL |= {
    "org_lookup": _sql(f"""SELECT k.org_id, coalesce(nullif(o.name, ''), CAST(k.org_id AS VARCHAR)) AS name, o.org_id IS NOT NULL AS known, coalesce(CAST(floor(epoch(o.last_updated)) AS BIGINT), 0) AS updated, coalesce({_AGE} > 365, true) AS stale
FROM (SELECT org_id FROM organisations UNION ALL SELECT 101) AS k LEFT JOIN organisations AS o USING (org_id)"""),
    "named_orgs": _sql("""SELECT competitor_id, year, n_bouts, primary_country, primary_org, CASE primary_org WHEN 'BUILDING' THEN 'BLD' WHEN 'OLD BUILDING' THEN 'OLD' WHEN 'MACHINERY' THEN 'MCH' WHEN 'FURNITURE' THEN 'FUR' ELSE primary_org END AS short_org FROM (
SELECT * REPLACE (CASE WHEN primary_org = 'BUILDING' AND year < 1997 THEN 'FIRST BUILDING' WHEN primary_org = 'BUILDING' AND year < 1999 THEN 'OLD BUILDING' WHEN primary_org = 'MACHINERY' AND year < 1998 THEN 'ENGINES' ELSE primary_org END AS primary_org) FROM prim)"""),
    "upserted_orgs": _sql(f"""SELECT org_id, org, CASE WHEN org_id IN (2, 3) THEN 'New ' || org ELSE name END AS name, CASE WHEN org_id = 2 THEN '1900' ELSE founded END AS founded, CASE WHEN org_id IN (2, 3) THEN {_AS_OF} ELSE last_updated END AS last_updated FROM organisations"""),
    "profile_facts": _sql("SELECT competitor_id, name, in_cohort, diverse, org, career_start, career_end, birthplace FROM facts"),
    "profile_rows": _sql("""SELECT competitor_id, coalesce(nullif(name, ''), 'Unknown') AS name, coalesce(CAST(floor(epoch(last_updated)) AS BIGINT), 0) AS updated FROM competitors LEFT JOIN updates USING (competitor_id)
UNION ALL SELECT -1, 'Unknown', 0 UNION ALL SELECT i, 'Missing', 0 FROM (SELECT unnest([5, 10, 20, 7777777]) AS i) WHERE i NOT IN (SELECT competitor_id FROM competitors)"""),
    "without_profile": _sql("SELECT competitor_id FROM facts WHERE blank"),
    "due_profiles": _sql("""SELECT competitor_id, round(age, 4) AS age, CASE WHEN age IS NULL THEN 'never' WHEN age < 1 THEN printf('%.0f hours', age * 24) WHEN age < 30 THEN printf('%.0f days', age) WHEN age < 365 THEN printf('%.1f months', age / 30) ELSE printf('%.1f years', age / 365) END AS age_text
FROM aged WHERE competitor_id NOT IN (5, 10, 20, 7777777, -1) AND (age IS NULL OR age > CASE WHEN in_cohort THEN 90 ELSE 365 END OR competitor_id % 11 = 0 OR competitor_id % 13 = 0)"""),
    "upserted_profiles": _sql("SELECT competitor_id, CASE WHEN competitor_id % 3 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN competitor_id % 3 = 0 AND competitor_id % 2 = 1 THEN 'NEW' ELSE country END AS country FROM competitors"),
    "inactive": _sql("SELECT * FROM inact"),
    "nationality": _sql("SELECT competitor_id, coalesce(at_home, false) AS at_home FROM natl"),
    "debut_anniversaries": _sql("""SELECT competitor_id, name, debut, CAST(2024 - year(debut) AS INTEGER) AS years, a AS anniversary, p.primary_org AS org FROM (
SELECT *, make_date(2024, month(debut), CASE WHEN month(debut) = 2 AND day(debut) = 29 THEN 28 ELSE day(debut) END) AS a FROM facts WHERE debut IS NOT NULL AND in_cohort)
LEFT JOIN (SELECT competitor_id, primary_org FROM prim WHERE year = 2001) AS p USING (competitor_id)
WHERE abs(date_diff('day', DATE '2024-06-30', a)) <= 60 AND competitor_id IN (SELECT competitor_id FROM natl WHERE at_home) AND competitor_id NOT IN (SELECT competitor_id FROM inact WHERE inactive)"""),
    "completeness": _sql("""SELECT in_cohort, count(*) AS n, count(career_start) AS with_career_start, count(career_end) AS with_career_end, count(birthplace) AS with_birthplace, count(*) FILTER (WHERE listed) AS with_bouts, count(*) FILTER (WHERE NOT listed) AS without_bouts
FROM (SELECT *, competitor_id IN (SELECT competitor_id FROM listings) AS listed FROM facts) GROUP BY 1"""),
    "career_decades": _sql("SELECT CAST(floor(career_start / 10) * 10 AS INTEGER) AS decade, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM facts WHERE career_start IS NOT NULL GROUP BY 1"),
    "guessed_spans": _sql("SELECT competitor_id, CAST(unnest(range(first_year, last_year + 1)) AS INTEGER) AS year FROM (SELECT competitor_id, coalesce(career_start, career_end) AS first_year, coalesce(career_end, 1994) AS last_year FROM facts WHERE career_end IS NOT NULL OR career_start > 1985) WHERE first_year <= last_year"),
    "stored_lists": _sql(f"SELECT competitor_id, year, bout_id, bout_date, org, country, is_victory, {_JOIN.format('participants')} AS participants FROM listings"),
    "list_lengths": _sql("SELECT competitor_id, year, CAST(n_bouts AS INTEGER) AS n_bouts FROM lists"),
    "rollup_counters": _sql(" UNION ALL ".join(_counts(*x) for x in (("listings", "country", "countries"), ("listings", "org", "orgs"), ("names_used", "name_used", "names")))),
    "upserted_lists": _sql("""SELECT competitor_id, year, count(DISTINCT l.bout_id) AS n_bouts, count(DISTINCT CASE WHEN t.id <> competitor_id THEN t.id END) AS n_opponents FROM relisted AS l JOIN taking AS t ON l.bout_id = t.bout_id GROUP BY 1, 2"""),
    "replaced_edges": _sql("SELECT * FROM edges WHERE (src, year) NOT IN (SELECT (src, year) FROM fresh_edges) UNION ALL SELECT * FROM fresh_edges"),
    "split_history": _sql("""SELECT competitor_id, year, n_bouts FROM stubbed AS s WHERE (competitor_id, year) NOT IN (SELECT (competitor_id, year) FROM split)
AND NOT (n_bouts = 0 AND competitor_id % 2 = 0 AND competitor_id IN (SELECT competitor_id FROM listings)) UNION ALL SELECT * FROM split"""),
    "purged_stubs": _sql("""SELECT 'gone' AS kind, count(*) AS n_rows, count(DISTINCT competitor_id) AS n_competitors FROM late WHERE competitor_id IN (SELECT competitor_id FROM late_only)
UNION ALL SELECT 'left', count(*), count(DISTINCT competitor_id) FROM late WHERE competitor_id NOT IN (SELECT competitor_id FROM late_only)"""),
    "empty_before": _sql("SELECT year, count(*) AS n_lists, count(*) FILTER (WHERE n_bouts = 0) AS n_empty FROM stubbed WHERE NOT (n_bouts = 0 AND year < 1995) GROUP BY 1"),
    "list_freshness": _sql(f"SELECT year, count(*) AS n_lists, round(avg({_AGE}), 5) AS mean_age, round(min({_AGE}), 5) AS newest_age, round(max({_AGE}), 5) AS oldest_age FROM lists WHERE last_updated IS NOT NULL GROUP BY 1"),
    "list_updates": _sql("""SELECT c.competitor_id, CAST(y.year AS INTEGER) AS year, coalesce(CAST(floor(epoch(l.last_updated)) AS BIGINT), 0) AS updated FROM competitors AS c CROSS JOIN (SELECT unnest([2000, 2001, 2002]) AS year) AS y LEFT JOIN lists AS l ON l.competitor_id = c.competitor_id AND l.year = y.year"""),
    "aged_stubs": _sql("SELECT competitor_id, stub_years, n_bouts FROM stubs WHERE n_stubs >= 3"),
    "stub_audit": _sql("SELECT * EXCLUDE (stub_years), n_populated = 1 AND coalesce(career_length >= 3, false) AS single, n_stubs >= 3 AS several FROM stubs WHERE n_stubs >= 3 OR n_populated = 1 AND career_length >= 3"),
    "empty_records": _sql("SELECT competitor_id, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM patchy WHERE year < 2002 AND n_bouts = 0 GROUP BY 1"),
    "earlier_stubs": _sql("""SELECT competitor_id FROM (SELECT competitor_id, year, CASE WHEN competitor_id % 2 <> 0 AND year = 2001 THEN 0 ELSE n_bouts END AS n FROM patchy)
GROUP BY 1 HAVING count(*) FILTER (WHERE n = 0 AND year = 2001) > 0 AND count(*) FILTER (WHERE n = 0 AND year < 2001) > 0"""),
    "nationality_by_year": _sql("""SELECT p.competitor_id, p.year, p.competitor_id IN (1, 2, 3) OR m.k = 'NATION_0' OR contains(p.primary_org, 'NATION_0') OR p.primary_org = 'BUILDING' AS at_home FROM prim_then AS p
JOIN (SELECT * FROM (SELECT competitor_id, country AS k, count(*) AS n FROM listings GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY competitor_id ORDER BY n DESC, k) = 1) AS m USING (competitor_id)"""),
    "latest_org": _sql("""SELECT i.competitor_id, i.last_year, CASE WHEN i.inactive THEN 'Inactive' ELSE p.latest_org END AS latest_org
FROM inact AS i LEFT JOIN (SELECT competitor_id, arg_max(primary_org, year) AS latest_org FROM prim_then GROUP BY 1) AS p USING (competitor_id)"""),
    "sampled_json": _sql(f"SELECT bout_id, bout_date, org, is_victory, {_JOIN.format('s0')} AS won, {_JOIN.format('s1')} AS lost FROM bouts ORDER BY md5('7-' || bout_id), bout_id LIMIT 200"),
    "recent_gaps": _sql("""SELECT count(*) AS n_cohort, count(*) FILTER (WHERE y1 OR y2) AS n_active, count(*) FILTER (WHERE (y1 OR y2) AND NOT y0) AS active_without_this_year, count(*) FILTER (WHERE NOT y1) AS without_last_year FROM (
SELECT c.competitor_id, coalesce(bool_or(year = 2002), false) AS y0, coalesce(bool_or(year = 2001), false) AS y1, coalesce(bool_or(year = 2000), false) AS y2 FROM competitors AS c LEFT JOIN lists AS l USING (competitor_id) WHERE c.in_cohort GROUP BY 1)"""),
    "most_active": _sql("SELECT competitor_id, c.name, n_bouts FROM (SELECT competitor_id, count(*) AS n_bouts FROM listings WHERE in_cohort AND year IN (2000, 2001) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) JOIN competitors AS c USING (competitor_id)"),
    "by_bouts": _sql("SELECT competitor_id, n_bouts FROM lists WHERE year = 2001"),
    "top_countries": _sql("SELECT country, count(*) AS n FROM listings WHERE in_cohort AND year IN (2000, 2001) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "top_orgs": _sql("SELECT org, count(*) AS n FROM facts WHERE in_cohort GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    "top_mixed_countries": _sql("SELECT country, count(*) FILTER (WHERE mixed) AS n_yes, count(*) FILTER (WHERE NOT mixed) AS n_no FROM mixes GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15"),
    "outside_shares": _sql("SELECT competitor_id, n_neighbours, n_neighbours - n_cohort AS n_outside, round((n_neighbours - n_cohort) / n_neighbours, 6) AS outside_share, 2 * (n_neighbours - n_cohort) > n_neighbours AND n_neighbours >= 10 AS mostly_outside FROM shares WHERE in_cohort AND n_neighbours > n_cohort"),
    "outside_summary": _sql("""SELECT count(*) FILTER (WHERE n_neighbours > n_cohort) AS n_with_outside, round(avg(n_neighbours - n_cohort) FILTER (WHERE n_neighbours > n_cohort), 6) AS mean_outside,
count(*) FILTER (WHERE 2 * (n_neighbours - n_cohort) > n_neighbours AND n_neighbours >= 10) AS n_mostly_outside, count(*) AS n_cohort FROM shares WHERE in_cohort"""),
    "competitor_years": _sql("SELECT competitor_id, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM lists GROUP BY 1"),
    "bouts_within_members": _sql("""SELECT bout_id, org FROM bouts WHERE bout_id IN (SELECT bout_id FROM (SELECT bout_id, org, k, unnest(s) AS id FROM (SELECT bout_id, org, unnest([0, 1]) AS k, unnest([s0, s1]) AS s FROM bouts)) AS x
LEFT JOIN active AS a ON x.org = a.org AND x.id = a.competitor_id GROUP BY bout_id, k HAVING count(*) = count(a.competitor_id))"""),
    "sampled_bouts": _sql(f"SELECT bout_id, bout_date, {_JOIN.format('participants')} AS participants FROM bouts WHERE len(participants) > 0 ORDER BY md5('42-' || bout_id), bout_id LIMIT 100"),
    "workload_report": SQL["workload_by_org"],
    "graph_report": f"SELECT CAST(year AS INTEGER) AS year, count(*) AS n, round(sum(weight), 3) AS weight, 'nodes' AS kind FROM ({SQL['network_nodes']}) GROUP BY 1 UNION ALL SELECT CAST(year AS INTEGER), count(*), round(sum(weight), 3), 'links' FROM ({SQL['network_links']}) GROUP BY 1",
    "national_links": _sql("""SELECT e.year, least(src, dst) AS source, greatest(src, dst) AS target, CAST(sum(e.n_bouts) AS BIGINT) AS n_listed, round(log10(sum(e.n_bouts)), 6) AS weight FROM edges AS e
JOIN home_cohort AS h ON e.src = h.competitor_id JOIN prim AS a ON e.src = a.competitor_id AND e.year = a.year JOIN prim AS b ON e.dst = b.competitor_id AND e.year = b.year JOIN home_cohort AS g ON e.dst = g.competitor_id
WHERE a.n_bouts >= 2 AND b.n_bouts >= 2 GROUP BY 1, 2, 3 HAVING sum(e.n_bouts) > 1"""),
    "prediction_cache": _sql(f"SELECT subject_id, confidence, {_AS_OF} - (subject_id // 10 % 5) * INTERVAL 1 HOUR AS made_at FROM guessed WHERE subject_id // 10 % 2 = 1 AND subject_id // 10 % 5 <= 2"),
    "restricted_plan": _sql(f"SELECT * FROM {_plan(targets='SELECT DISTINCT id FROM taking WHERE id % 4 = 1 OR id % 20 = 0')}"),
    "date_texts": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN d WHEN 1 THEN CAST(date_trunc('month', d) AS DATE) WHEN 2 THEN CAST(date_trunc('year', d) AS DATE) END AS read, d AS first, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(year(d) AS INTEGER) END AS year,
strftime(d, '%G-W%V') AS week, make_date(2023, month(d), CASE WHEN month(d) = 2 AND day(d) = 29 THEN 28 ELSE day(d) END) AS anniversary FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "venues": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN 'Unknown' WHEN n_name = 'NATION_1' THEN 'First' ELSE n_name END AS country, c_custkey % 3 = 0 AS stand_in, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "parsed_bouts": _sql(f"""SELECT s.bout_id AS page_id, bout_date, 'Bout' AS bout_type, country, org_id, is_victory, 2 AS n_sides, {_JOIN.format('p0')} AS won, {_JOIN.format('p1')} AS lost, {_JOIN.format('list_sort(list_distinct(list_concat(p0, p1)))')} AS participants,
CAST(coalesce(n.n, 0) AS INTEGER) AS n_teams, CASE WHEN len(p0) = 1 AND len(p1) = 1 THEN 'singles' WHEN len(p0) = 2 AND len(p1) = 2 THEN 'tag_team' ELSE 'other_two_sided' END AS type
FROM shown AS s JOIN organisations USING (org) LEFT JOIN (SELECT bout_id, count(*) AS n FROM named GROUP BY 1) AS n ON s.bout_id = n.bout_id"""),
    "parsed_teams": _sql(f"SELECT bout_id AS page_id, CAST(total AS BIGINT) AS team_id, 'Team ' || total AS name, CASE WHEN total % 2 = 0 THEN 'tag_team' ELSE 'stable' END AS kind, {_JOIN.format('s')} AS members FROM named"),
    "team_links": _sql("""SELECT b.year, count(*) AS n_bouts, count(*) FILTER (WHERE len(s0) >= 2 OR len(s1) >= 2) AS n_tag, count(*) FILTER (WHERE linked) AS n_linked, count(*) FILTER (WHERE linked) AS n_named, coalesce(any_value(t.n), 0) AS n_teams
FROM (SELECT *, bout_id IN (SELECT bout_id FROM named) AS linked FROM bouts) AS b LEFT JOIN (SELECT year, count(DISTINCT total) AS n FROM named GROUP BY 1) AS t ON b.year = t.year GROUP BY 1"""),
    "reparse_audit": _sql("""SELECT kind, count(*) FILTER (WHERE found) AS n FROM (SELECT unnest(['only_old', 'only_new', 'sides', 'victory', 'newly_multi_sided', 'all']) AS kind,
unnest([false, bout_id % 10 = 3, bout_id % 10 = 3 OR bout_id % 7 = 0, bout_id % 10 = 3 OR (is_victory AND bout_id % 5 = 0), false, true]) AS found FROM bouts) GROUP BY 1"""),
    "profile_pages": _sql("SELECT competitor_id AS page_id, CASE WHEN competitor_id % 3 <> 0 THEN name ELSE 'Ego ' || name END AS name, competitor_id IN (1, 2) OR in_cohort AS in_cohort, CAST(1950 + competitor_id % 40 AS VARCHAR) AS founded, country, '1999,2000' AS years FROM competitors"),
}


#: Ratings by period in a recursive query: for each year the periods of the year before, without a seed, then its own.
_SCALE = 173.7178
_G = "(1 / sqrt(1 + 3 * {0} * {0} / (pi() * pi())))"
_ROOT = """list_reduce(list_prepend({'lo': ln(sigma * sigma) - 20, 'hi': ln(sigma * sigma) + 20}, list_transform(range(60), lambda i: {'lo': 0.0, 'hi': 0.0})), lambda s, i:
    CASE WHEN exp((s.lo + s.hi) / 2) * (delta * delta - phi * phi - v - exp((s.lo + s.hi) / 2)) / (2 * power(phi * phi + v + exp((s.lo + s.hi) / 2), 2)) - ((s.lo + s.hi) / 2 - ln(sigma * sigma)) / 0.25 > 0
         THEN {'lo': (s.lo + s.hi) / 2, 'hi': s.hi} ELSE {'lo': s.lo, 'hi': (s.lo + s.hi) / 2} END)"""
_RATED = f"""
WITH RECURSIVE {_MORE.strip()}, results AS (
  SELECT CAST(year(bout_date) AS INTEGER) AS gy, dense_rank() OVER (PARTITION BY year(bout_date) ORDER BY month(bout_date)) AS step, id, opp, score FROM (
    SELECT bout_date, a AS id, b AS opp, CASE WHEN is_victory THEN 1.0 ELSE 0.5 END AS score FROM singles UNION ALL SELECT bout_date, b, a, CASE WHEN is_victory THEN 0.0 ELSE 0.5 END FROM singles)
), years AS (SELECT DISTINCT gy AS y FROM results
), seq AS (
  SELECT y, gy, step, row_number() OVER (PARTITION BY y ORDER BY gy, step) AS k, gy = y AND step = 1 AS turn
  FROM years JOIN (SELECT DISTINCT gy, step FROM results) AS p ON p.gy IN (y - 1, y)
), played AS (SELECT s.y, s.k, r.id, r.opp, r.score FROM seq AS s JOIN results AS r ON s.gy = r.gy AND s.step = r.step
), rated AS (
  SELECT y, CAST(0 AS BIGINT) AS k, CAST(-99 AS BIGINT) AS id, 0.0::DOUBLE AS mu, 1.0::DOUBLE AS phi, 0.06::DOUBLE AS sigma, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS l, CAST(0 AS BIGINT) AS d FROM years
  UNION ALL
  (WITH now AS (
    SELECT s.y, s.k, id, mu, phi, CASE WHEN turn THEN 0.06 ELSE sigma END AS sigma, CASE WHEN turn THEN 0 ELSE w END AS w, CASE WHEN turn THEN 0 ELSE l END AS l, CASE WHEN turn THEN 0 ELSE d END AS d
    FROM rated AS r JOIN seq AS s ON r.y = s.y AND s.k = r.k + 1 WHERE NOT turn OR w + l + d >= 3 OR id = -99
  ), met AS (
    SELECT p.y, p.k, p.id, p.score, coalesce(a.mu, 0.0) AS mu, coalesce(b.mu, 0.0) AS mu_o, coalesce(b.phi, 400 / {_SCALE}) AS phi_o
    FROM (SELECT DISTINCT y, k FROM now) AS t JOIN played AS p ON p.y = t.y AND p.k = t.k LEFT JOIN now AS a ON a.y = p.y AND a.id = p.id LEFT JOIN now AS b ON b.y = p.y AND b.id = p.opp
  ), sums AS (
    SELECT y, k, id, 1 / sum(g * g * e * (1 - e)) AS v, sum(g * (score - e)) AS up, count(*) FILTER (WHERE score = 1) AS won, count(*) FILTER (WHERE score = 0) AS lost, count(*) FILTER (WHERE score = 0.5) AS drawn
    FROM (SELECT *, {_G.format("phi_o")} AS g, 1 / (1 + exp(-{_G.format("phi_o")} * (mu - mu_o))) AS e FROM met) GROUP BY 1, 2, 3
  ), joined AS (
    SELECT coalesce(n.y, s.y) AS y, coalesce(n.k, s.k) AS k, coalesce(n.id, s.id) AS id, coalesce(mu, 0.0) AS mu, coalesce(phi, 400 / {_SCALE}) AS phi, coalesce(sigma, 0.06) AS sigma,
           coalesce(w, 0) + coalesce(won, 0) AS w, coalesce(l, 0) + coalesce(lost, 0) AS l, coalesce(d, 0) + coalesce(drawn, 0) AS d, v IS NOT NULL AS active, coalesce(v, 1.0) AS v, coalesce(up, 0.0) AS up, coalesce(v * up, 0.0) AS delta
    FROM now AS n FULL OUTER JOIN sums AS s ON n.y = s.y AND n.id = s.id
  ), solved AS (SELECT *, CASE WHEN active THEN exp(({_ROOT}).lo / 2) ELSE sigma END AS new_sigma FROM joined
  ), moved AS (
    SELECT *, CASE WHEN active THEN 1 / sqrt(1 / (phi * phi + new_sigma * new_sigma) + 1 / v) ELSE sqrt(phi * phi + new_sigma * new_sigma) END AS new_phi FROM solved
  )
  SELECT y, k, id, CASE WHEN active THEN mu + new_phi * new_phi * up ELSE mu END, new_phi, new_sigma, CAST(w AS BIGINT), CAST(l AS BIGINT), CAST(d AS BIGINT) FROM moved)
), state AS (
  SELECT r.y AS year, id AS competitor_id, mu * {_SCALE} + 1500 AS rating, phi * {_SCALE} AS deviation, w, l, d FROM rated AS r JOIN (SELECT y, max(k) AS k FROM seq GROUP BY 1) AS m ON r.y = m.y AND r.k = m.k WHERE id <> -99
)
"""
_SHORT_THEN = """CASE WHEN primary_org = 'BUILDING' AND year < 1997 THEN 'FIRST BUILDING' WHEN primary_org = 'BUILDING' AND year < 1999 THEN 'OLD' WHEN primary_org = 'BUILDING' THEN 'BLD'
WHEN primary_org = 'MACHINERY' AND year < 1998 THEN 'ENGINES' WHEN primary_org = 'MACHINERY' THEN 'MCH' WHEN primary_org = 'FURNITURE' THEN 'FUR' ELSE primary_org END"""
SQL["ranking_table"] = f"""{_RATED}
SELECT s.year, CAST(row_number() OVER (PARTITION BY s.year ORDER BY rating DESC, s.competitor_id) AS INTEGER) AS rank, s.competitor_id, coalesce(n.name, c.name, 'Unknown') AS name, p.org, round(rating, 3) AS rating, round(deviation, 3) AS deviation,
       CASE WHEN d > 0 THEN w || '-' || l || '-' || d ELSE w || '-' || l END AS record
FROM state AS s LEFT JOIN competitors AS c USING (competitor_id)
LEFT JOIN (SELECT competitor_id, year, name_used AS name FROM (SELECT competitor_id, year, name_used, count(*) AS n FROM names_used GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY competitor_id, year ORDER BY n DESC, name_used) = 1) AS n USING (competitor_id, year)
LEFT JOIN (SELECT competitor_id, year, {_SHORT_THEN} AS org FROM prim) AS p USING (competitor_id, year)
WHERE w + l + d >= 3 AND s.year IN (SELECT year FROM listings GROUP BY competitor_id, year HAVING count(*) > 8)"""
SQL["upsets"] = f"""{_RATED}
SELECT bout_date, a, b, coalesce(x.rating < y.rating, false) AS upset, coalesce(y.rating < x.rating - 2 * x.deviation, false) AS squash
FROM singles LEFT JOIN state AS x ON x.competitor_id = a AND x.year = year(bout_date) LEFT JOIN state AS y ON y.competitor_id = b AND y.year = year(bout_date) WHERE is_victory"""
