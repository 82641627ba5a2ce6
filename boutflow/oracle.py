"""SQL with the rows of the registered queries, for another engine to check them against."""

from __future__ import annotations

_BASE = """
sides AS (
  SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber % 2 = 1)) AS s0,
         list_sort(list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber % 2 = 0)) AS s1,
         list_sort(list(DISTINCT l_suppkey)) AS participants
  FROM lineitem GROUP BY l_orderkey
), bouts AS (
  SELECT o_orderkey AS bout_id, CAST(o_orderdate AS DATE) AS bout_date, CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS org,
         n_name AS country, o_orderstatus <> 'P' AS is_victory, s0, s1, participants, len(participants) AS size
  FROM orders JOIN sides ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE len(s0) > 0 AND len(s1) > 0
), competitors AS (
  SELECT s_suppkey AS competitor_id, s_name AS name, n_name AS country, s_nationkey % 3 <> 0 AS in_cohort, s_acctbal < 0 AS diverse
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0
), taking AS (
  SELECT bout_id, unnest(participants) AS id FROM bouts
), listings AS (
  SELECT c.competitor_id, c.in_cohort, b.* FROM taking AS t JOIN competitors AS c ON t.id = c.competitor_id JOIN bouts AS b ON t.bout_id = b.bout_id
), names_used AS (
  SELECT DISTINCT l.competitor_id, l.bout_id, l.year, p_brand AS name_used
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN listings AS l ON l_orderkey = l.bout_id AND l_suppkey = l.competitor_id
), edges AS (
  SELECT competitor_id AS src, t.id AS dst, year, count(*) AS n_bouts FROM listings AS l JOIN taking AS t ON l.bout_id = t.bout_id
  WHERE t.id <> competitor_id GROUP BY ALL
), dedges AS (SELECT DISTINCT src, dst FROM edges
), shares AS (
  SELECT c.competitor_id, c.in_cohort, count(e.dst) AS n_neighbours, count(*) FILTER (WHERE d.in_cohort) AS n_cohort,
         round(CASE WHEN count(e.dst) > 0 THEN (count(*) FILTER (WHERE d.in_cohort)) / count(e.dst) ELSE 0.0 END, 6) AS cohort_share
  FROM competitors AS c LEFT JOIN dedges AS e ON c.competitor_id = e.src LEFT JOIN competitors AS d ON e.dst = d.competitor_id
  GROUP BY c.competitor_id, c.in_cohort
), missing AS (
  SELECT dst AS missing_id, count(DISTINCT src) AS n_referrers, sum(n_bouts) AS appearances FROM edges
  WHERE dst NOT IN (SELECT competitor_id FROM competitors) GROUP BY dst
), org_counts AS (SELECT competitor_id, year, org AS k, count(*) AS n FROM listings GROUP BY ALL
), country_counts AS (SELECT competitor_id, year, country AS k, count(*) AS n FROM listings GROUP BY ALL
), prim AS (
  SELECT b.competitor_id, b.year, b.n_bouts,
         CASE WHEN o.n >= 0.25 * b.n_bouts THEN o.k ELSE 'Freelancer (' || c.k || ')' END AS primary_org, c.k AS primary_country
  FROM (SELECT competitor_id, year, count(*) AS n_bouts FROM listings GROUP BY ALL) AS b
  JOIN (SELECT * FROM org_counts QUALIFY row_number() OVER (PARTITION BY competitor_id, year ORDER BY n DESC, k) = 1) AS o USING (competitor_id, year)
  JOIN (SELECT * FROM country_counts QUALIFY row_number() OVER (PARTITION BY competitor_id, year ORDER BY n DESC, k) = 1) AS c USING (competitor_id, year)
), prim_then AS (
  SELECT *, CASE primary_org WHEN 'BUILDING' THEN 'BLD' WHEN 'OLD BUILDING' THEN 'OLD' WHEN 'MACHINERY' THEN 'MCH' WHEN 'FURNITURE' THEN 'FUR' ELSE primary_org END AS short_org FROM (
    SELECT * REPLACE (CASE WHEN primary_org = 'BUILDING' AND year < 1997 THEN 'FIRST BUILDING' WHEN primary_org = 'BUILDING' AND year < 1999 THEN 'OLD BUILDING' WHEN primary_org = 'MACHINERY' AND year < 1998 THEN 'ENGINES' ELSE primary_org END AS primary_org) FROM prim)
), used_then AS (
  SELECT competitor_id, year, name_used FROM (SELECT competitor_id, year, name_used, count(*) AS n FROM names_used GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY competitor_id, year ORDER BY n DESC, name_used) = 1
), cohort_edges AS (
  SELECT e.* FROM edges AS e JOIN competitors AS c ON e.src = c.competitor_id WHERE c.in_cohort
), singles AS (
  SELECT DISTINCT bout_date, s0[1] AS a, s1[1] AS b, is_victory FROM bouts
  WHERE len(s0) = 1 AND len(s1) = 1 AND s0[1] <> s1[1]
    AND s0[1] IN (SELECT competitor_id FROM competitors WHERE in_cohort) AND s1[1] IN (SELECT competitor_id FROM competitors WHERE in_cohort)
), scored AS (
  SELECT *, org IN ('BUILDING', 'MACHINERY') AS cohort_org, country = 'NATION_0' AS at_home,
         greatest(0.01, least(0.99, CAST(0.28 AS DOUBLE) * CASE WHEN size = 2 THEN 0.6 WHEN size >= 5 THEN 1.8 ELSE 1.0 END
           * CASE WHEN org IN ('BUILDING', 'MACHINERY') THEN 0.2 ELSE 1.0 END
           * CASE WHEN year >= 2023 THEN 1.1 WHEN year >= 2010 THEN 1.0 WHEN year >= 2000 THEN 0.7 ELSE 0.3 END
           * CASE WHEN country = 'NATION_0' THEN 0.85 WHEN country IN ('NATION_1', 'NATION_2', 'NATION_3') THEN 1.2 ELSE 1.0 END)) AS probability
  FROM bouts
), seen AS (
  SELECT l.competitor_id, t.id AS subject_id, s.* FROM listings AS l JOIN scored AS s ON l.bout_id = s.bout_id JOIN taking AS t ON t.bout_id = l.bout_id
  WHERE t.id <> l.competitor_id
), lost AS (SELECT * FROM seen WHERE subject_id NOT IN (SELECT competitor_id FROM competitors)
), ratios AS (
  SELECT subject_id, count(*) AS n_rows, avg(cohort_org::INT) AS co, avg(at_home::INT) AS jp, round(avg(probability), 9) AS p FROM lost GROUP BY subject_id
), guessed AS (
  SELECT subject_id, n_rows, round(co, 6) AS cohort_share, round(jp, 6) AS home_share, round(p, 6) AS mean_probability,
         round(CASE WHEN co >= 0.1 THEN 0.95 WHEN jp >= 0.3 THEN 0.95 WHEN p < 0.15 THEN 0.95 WHEN p < 0.20 AND co >= 0.05 THEN 0.95
           WHEN p < 0.20 THEN 0.85 WHEN jp >= 0.2 THEN 0.80 WHEN n_rows >= 50 AND p < 0.30 THEN 0.75 WHEN p < 0.25 THEN 0.70 WHEN p < 0.35 THEN 0.55
           WHEN p > 0.50 THEN 0.20 WHEN p > 0.45 AND jp < 0.1 THEN 0.15
           WHEN p <= 0.309 THEN 0.5 + (0.309 - p) * 0.5 WHEN p <= 0.426 THEN 0.5 - (p - 0.309) * (0.2 / 0.117)
           ELSE greatest(0.3 - (p - 0.426) * 0.5, 0.05) END, 6) AS confidence
  FROM ratios
), vectors AS (
  SELECT subject_id, CAST(count(*) AS DOUBLE) AS n_rows, CAST(count(DISTINCT competitor_id) AS DOUBLE) AS n_opponents, avg(cohort_org::INT) AS cohort_share,
         avg(at_home::INT) AS home_share, avg(size) AS mean_size, avg((len(s0) = 1 AND len(s1) = 1)::INT) AS singles_share, 0.0::DOUBLE AS multi_share,
         CAST(count(DISTINCT country) AS DOUBLE) AS n_countries, CAST(count(DISTINCT org) AS DOUBLE) AS n_orgs, avg(probability) AS mean_probability,
         (1 - avg(probability)) / avg(probability) AS likelihood_ratio
  FROM seen GROUP BY subject_id
), known AS (
  SELECT v.*, c.in_cohort FROM vectors AS v JOIN competitors AS c ON v.subject_id = c.competitor_id
), firsts AS (
  SELECT * FROM bouts QUALIFY row_number() OVER (PARTITION BY bout_date, participants ORDER BY bout_id) = 1
), mixes AS (
  SELECT f.*, m.outside > 0 AS mixed FROM firsts AS f JOIN (
    SELECT t.bout_id, count(*) FILTER (WHERE in_cohort) AS inside, count(*) FILTER (WHERE NOT in_cohort) AS outside
    FROM taking AS t JOIN competitors AS c ON t.id = c.competitor_id GROUP BY t.bout_id) AS m ON f.bout_id = m.bout_id WHERE m.inside > 0
), outcomes AS (SELECT DISTINCT bout_date, org, s0, s1 FROM bouts
), teams AS (
  SELECT org, members, len(members) AS size, array_to_string(members, '-') AS team, count(*) AS n_bouts FROM (
    SELECT org, unnest([s0, s1]) AS members FROM outcomes WHERE len(s0) = len(s1) AND len(s0) BETWEEN 2 AND 3) GROUP BY org, members
), pairs AS (
  SELECT org, a AS member, b AS partner, sum(n_bouts) AS n_bouts FROM (
    SELECT org, a, unnest(members) AS b, n_bouts FROM (SELECT org, unnest(members) AS a, members, n_bouts FROM teams)) WHERE a <> b GROUP BY ALL
), active AS (
  SELECT org, competitor_id, count(*) AS n_bouts FROM listings WHERE year BETWEEN 2000 AND 2001 GROUP BY ALL HAVING count(*) >= 10
), freq AS (
  SELECT org, count(*) AS n_bouts, count(DISTINCT competitor_id) AS n_competitors FROM listings WHERE in_cohort GROUP BY org
), updates AS (
  SELECT user_id AS competitor_id, max(ts) AS last_updated FROM events GROUP BY user_id
), aged AS (
  SELECT c.*, (epoch(TIMESTAMP '2024-06-30 00:00:00') - floor(epoch(u.last_updated))) / 86400.0 AS age FROM competitors AS c LEFT JOIN updates AS u USING (competitor_id)
), organisations AS (
  SELECT org, org_id, CASE WHEN org_id <> 3 THEN 'Org ' || org END AS name, CAST(1990 + org_id AS VARCHAR) AS founded,
         CASE WHEN org_id <> 4 THEN (SELECT max(ts) FROM events WHERE user_id % 5 = org_id - 1) - org_id * INTERVAL 100 DAY END AS last_updated
  FROM (SELECT org, dense_rank() OVER (ORDER BY org) AS org_id FROM (SELECT DISTINCT c_mktsegment AS org FROM customer))
), importances AS (
  SELECT competitor_id, n_bouts, n_opponents, round(0.6 * least(n_bouts / 100.0, 1.0) + 0.4 * least(n_opponents / 50.0, 1.0), 6) AS importance
  FROM (SELECT competitor_id, count(*) AS n_bouts FROM listings WHERE year IN (2000, 2001) GROUP BY ALL)
  LEFT JOIN (SELECT src AS competitor_id, count(DISTINCT dst) AS n_opponents FROM edges WHERE year IN (2000, 2001) GROUP BY ALL) USING (competitor_id)
), dated AS (
  SELECT l.competitor_id, l.year, (epoch(TIMESTAMP '2024-06-30 00:00:00') - floor(epoch(CASE WHEN (l.competitor_id + l.year) % 11 <> 0 THEN u.last_updated - (2002 - l.year) * INTERVAL 50 DAY + ((l.competitor_id * 37 + l.year * 61) % 400) * INTERVAL 1 DAY END))) / 86400.0 AS list_age
  FROM (SELECT DISTINCT competitor_id, year FROM listings) AS l LEFT JOIN updates AS u USING (competitor_id)
  UNION ALL SELECT competitor_id, 2002, competitor_id * 7 % 40 FROM competitors WHERE competitor_id % 4 = 0
), people AS (
  SELECT a.*, i.competitor_id IS NOT NULL AS active, coalesce(i.importance, 0) AS importance FROM aged AS a LEFT JOIN importances AS i USING (competitor_id)
), cohort_missing AS (
  SELECT dst AS missing_id, count(DISTINCT src) AS n_referrers FROM edges
  WHERE dst NOT IN (SELECT competitor_id FROM competitors) AND src IN (SELECT competitor_id FROM competitors WHERE in_cohort) GROUP BY dst
)
"""


def _sql(body: str) -> str:
    return f"WITH {_BASE} {body}"


def _plan(force: bool = False, only_bouts: bool = False, january: bool = False, targets: str = "") -> str:
    """The refresh plan, written from its rules; ``targets``: a query of the ids (id) that it is restricted to."""
    wanted = f"competitor_id IN ({targets})" if targets else "in_cohort"
    current = f"CAST(greatest(1, {90 if january else 10} - floor(5 * importance)) AS INTEGER)"
    previous = "CAST(greatest(1, 10 - floor(5 * importance)) AS INTEGER)" if january else "30"
    forced = f"CASE WHEN year = 2002 THEN CASE WHEN active THEN {current} ELSE 999 END WHEN year = 2001 THEN {previous} ELSE least(50 + 2002 - year, 99) END"
    due = """in_cohort AND (list_age IS NULL OR year = 2002 AND active AND list_age > 14 OR year = 2001 AND list_age > 90 OR year < 2001 AND list_age > CASE WHEN active THEN 180 ELSE 365 END)"""
    rank = """CASE WHEN active THEN CASE WHEN year = 2002 THEN 10 WHEN year = 2001 THEN 30 ELSE least(50 + 2002 - year, 99) END
      ELSE CASE WHEN year = 2002 THEN 99 WHEN year >= 2000 THEN 80 ELSE 80 + least(2002 - year, 19) END END"""
    stale = "true" if force else "(age IS NULL OR age > CASE WHEN in_cohort THEN 90 ELSE 365 END)"
    no_current = "competitor_id NOT IN (SELECT competitor_id FROM dated WHERE year = 2002)"
    item = lambda priority, stage, operation, object_id, year, rest: f"SELECT CAST({priority} AS INTEGER) AS priority, {stage} AS stage, '{operation}' AS operation, CAST({object_id} AS VARCHAR) AS object_id, CAST({year} AS INTEGER) AS year {rest}"
    lists = f"""SELECT *, count(*) OVER (PARTITION BY competitor_id) AS n, min(priority) OVER (PARTITION BY competitor_id) AS best FROM (
      SELECT competitor_id, year, {forced if force else rank} AS priority FROM dated JOIN people USING (competitor_id) WHERE {wanted} AND {"true" if force else due}
      UNION ALL SELECT competitor_id, 2002, {current} FROM people WHERE {wanted} AND active AND {no_current})"""
    parts = [item("best", 4, "refresh_all_bouts", "competitor_id", "NULL", f"FROM ({lists}) WHERE n >= 3"), item("priority", 4, "refresh_bouts", "competitor_id", "year", f"FROM ({lists}) WHERE n < 3")]
    if not only_bouts:
        counts = f"(SELECT org, count(*) AS n_bouts FROM listings WHERE {wanted} GROUP BY org)"
        old = "true" if force else "(last_updated IS NULL OR epoch(TIMESTAMP '2024-06-30 00:00:00') - floor(epoch(last_updated)) > 365 * 86400)"
        parts.append(item("greatest(0, least(95, 95 - floor(n_bouts / 100)))", 5, "refresh_org", "org", "NULL", f"FROM {counts} JOIN organisations USING (org) WHERE {old}"))
        if targets:
            parts.append(item(10, 1, "refresh_profile", "id", "NULL", f"FROM ({targets}) WHERE id NOT IN (SELECT competitor_id FROM competitors)"))
            parts.append(item(10, 2, "refresh_profile", "competitor_id", "NULL", f"FROM people WHERE {wanted} AND {stale}"))
        else:
            sure = """CASE WHEN n < 5 AND c >= 0.75 THEN greatest(40, base) WHEN n < 5 THEN base
        WHEN c >= 0.95 THEN CASE WHEN n >= 20 THEN 1 + least(floor((1 - c) * 20), 2) WHEN n >= 10 THEN 5 + least(floor((1 - c) * 30), 3) ELSE 10 + least(floor((1 - c) * 50), 5) END
        WHEN c >= 0.75 THEN CASE WHEN n >= 20 THEN 10 + floor((0.95 - c) * 10) WHEN n >= 10 THEN 15 + floor((0.95 - c) * 15) ELSE 20 + floor((0.95 - c) * 25) END
        WHEN c >= 0.5 THEN base WHEN c >= 0.3 THEN greatest(70, least(95, base + 20)) ELSE greatest(80, least(98, base + 40)) END"""
            found = """FROM (SELECT missing_id, n_referrers AS n, CAST(confidence AS DOUBLE) AS c,
            CASE WHEN n_referrers >= 20 THEN 1 WHEN n_referrers >= 10 THEN 10 WHEN n_referrers >= 5 THEN 30 WHEN n_referrers >= 3 THEN 60 + (4 - n_referrers) ELSE 90 + (2 - n_referrers) END AS base
          FROM cohort_missing JOIN guessed ON missing_id = subject_id)"""
            parts.append(item(sure, 1, "refresh_profile", "missing_id", "NULL", found))
            parts.append(item(10, "CASE WHEN in_cohort THEN 2 ELSE 3 END", "refresh_profile", "competitor_id", "NULL", f"FROM people WHERE {stale}"))
            again = "true" if force else "(list_age IS NULL OR list_age > 14)"
            parts.append(item(f"greatest(1, {50 if january else 10} - floor(5 * importance))", 6, "refresh_bouts", "competitor_id", "2002", f"FROM people AS p LEFT JOIN (SELECT competitor_id, list_age FROM dated WHERE year = 2002) AS d USING (competitor_id) WHERE diverse AND {again}"))
    union = " UNION ALL ".join(parts)
    return f"(SELECT arg_min(priority, stage * 1000 + priority) AS priority, CAST(min(stage) AS INTEGER) AS stage, operation, object_id, year FROM ({union}) GROUP BY operation, object_id, year)"


def _counter(table: str, key: str, by: str = "competitor_id, year") -> str:
    return f"(SELECT {by}, string_agg(CAST(k AS VARCHAR) || '=' || n, ',' ORDER BY k) AS c FROM (SELECT {by}, {key} AS k, count(*) AS n FROM {table} GROUP BY ALL) GROUP BY {by})"


def _bucketed(table: str, n: str, bounds: list[int]) -> str:
    cases, low = "", 1
    for b in bounds:
        cases += f"WHEN {n} <= {b} THEN '{b if low == b else f'{low}-{b}'}' "
        low = b + 1
    return f"SELECT CASE {cases}ELSE '{bounds[-1]}+' END AS bucket, count(*) AS n_ids, sum({n}) AS total, min({n}) AS least, max({n}) AS most, round(avg({n}), 6) AS mean FROM {table} GROUP BY 1"


def _quartile(i: int) -> str:
    at = f"greatest(1, least(n - 1, CAST(floor({i} * (n + 1) / 4) AS BIGINT)))"
    return f"round((v[{at}] * (4 - ({i} * (n + 1) - 4 * {at})) + v[{at} + 1] * ({i} * (n + 1) - 4 * {at})) / 4.0, 6)"


_RULES = [
    *((f"cohort_share>={v}", f"round(cohort_share, 9) >= {v}") for v in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)),
    *((f"home_share>={v}", f"round(home_share, 9) >= {v}") for v in (0.02, 0.04, 0.06, 0.1, 0.2, 0.3)),
    *((f"mean_probability<{v}", f"round(mean_probability, 9) < {v}") for v in (0.05, 0.08, 0.1, 0.15, 0.2, 0.25)),
]
_FEATURES = ("n_rows", "n_opponents", "cohort_share", "home_share", "mean_size", "singles_share", "multi_share", "n_countries", "n_orgs", "mean_probability", "likelihood_ratio")
_G = "(1 / sqrt(1 + 3 * power(400.0 / 173.7178, 2) / power(pi(), 2)))"
_ISSUES = {
    "sentinel": "list_contains(participants, -1)", "sides_differ": "false", "empty_side": "false", "no_winner": "NOT is_victory",
    "on_both_sides": "len(list_intersect(s0, s1)) > 0", "large": "size > 6",
}

SQL: dict[str, str] = {
    "singles_bouts": _sql("SELECT * FROM singles"),
    "yearly_rollup": _sql(f"""
SELECT b.competitor_id, b.year, b.n_bouts, coalesce(o.n_opponents, 0) AS n_opponents, coalesce(o.opponents, '') AS opponents, co.c AS countries, og.c AS orgs, nm.c AS names
FROM (SELECT competitor_id, year, count(*) AS n_bouts FROM listings GROUP BY ALL) AS b
LEFT JOIN (SELECT src, year, count(*) AS n_opponents, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY n_bouts DESC, dst) AS opponents FROM edges GROUP BY ALL) AS o ON b.competitor_id = o.src AND b.year = o.year
LEFT JOIN {_counter("listings", "country")} AS co ON b.competitor_id = co.competitor_id AND b.year = co.year
LEFT JOIN {_counter("listings", "org")} AS og ON b.competitor_id = og.competitor_id AND b.year = og.year
LEFT JOIN {_counter("names_used", "name_used")} AS nm ON b.competitor_id = nm.competitor_id AND b.year = nm.year"""),
    "edge_weights": _sql("SELECT * FROM edges"),
    "cohort_share": _sql("SELECT * FROM shares"),
    "neighbours_reverse": _sql("SELECT dst AS competitor_id, count(DISTINCT src) AS n_sources, sum(n_bouts) AS n_bouts FROM edges GROUP BY dst"),
    "missing_ids": _sql("SELECT * FROM missing"),
    "missing_buckets": _sql(_bucketed("missing", "appearances", [1, 5, 10, 20])),
    "outside_buckets": _sql(_bucketed("(SELECT e.dst, count(*) AS n_lists FROM dedges AS e JOIN competitors AS a ON e.src = a.competitor_id JOIN competitors AS b ON e.dst = b.competitor_id WHERE a.in_cohort AND NOT b.in_cohort GROUP BY e.dst)", "n_lists", [1, 5, 10, 20, 50])),
    "primary_org": _sql("SELECT * EXCLUDE (short_org) FROM prim_then"),
    "primary_country": _sql("""SELECT m.competitor_id, m.k AS country, m.n AS country_bouts, t.c AS countries
FROM (SELECT * FROM (SELECT competitor_id, country AS k, count(*) AS n FROM listings GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY competitor_id ORDER BY n DESC, k) = 1) AS m
JOIN """ + _counter("listings", "country", "competitor_id") + " AS t USING (competitor_id)"),
    "primary_name": _sql("SELECT * FROM (SELECT competitor_id, year, name_used AS primary_name, count(*) AS primary_name_bouts FROM names_used GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY competitor_id, year ORDER BY primary_name_bouts DESC, primary_name) = 1"),
    "org_members": _sql("SELECT DISTINCT l.org, t.id AS competitor_id FROM listings AS l JOIN taking AS t USING (bout_id) WHERE l.in_cohort"),
    "active_members": _sql("SELECT * FROM active"),
    "org_frequency": _sql("SELECT * FROM freq"),
    "workload_by_org": _sql(f"""SELECT year, org, n AS n_competitors, total, {_quartile(1)} AS q1, {_quartile(2)} AS median, {_quartile(3)} AS q3, most FROM (
SELECT p.year, p.short_org AS org, count(*) AS n, sum(n_bouts) AS total, max(n_bouts) AS most, list_sort(list(n_bouts)) AS v
FROM prim_then AS p JOIN competitors AS c USING (competitor_id) WHERE c.in_cohort GROUP BY 1, 2) WHERE n >= 5"""),
    "workload_hist": _sql("SELECT year, CAST(least(floor(n / 6) + 1, 20) AS INTEGER) AS bin, count(*) AS n_competitors FROM (SELECT year, competitor_id, count(*) AS n FROM listings WHERE in_cohort GROUP BY ALL) WHERE n BETWEEN 0 AND 120 GROUP BY 1, 2"),
    "workload_percentiles": _sql("SELECT year, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75 FROM (SELECT year, competitor_id, count(*) AS n FROM listings WHERE in_cohort GROUP BY ALL) GROUP BY year"),
    "year_stats": _sql("SELECT year, count(*) AS n_competitors, count(*) FILTER (WHERE in_cohort) AS n_cohort, sum(n) AS n_bouts, coalesce(sum(n) FILTER (WHERE in_cohort), 0) AS cohort_bouts, round(avg(n), 6) AS avg_bouts FROM (SELECT competitor_id, year, in_cohort, count(*) AS n FROM listings GROUP BY ALL) GROUP BY year"),
    "available_years": _sql("SELECT year, lag(year) OVER (ORDER BY year) AS previous_year, lead(year) OVER (ORDER BY year) AS next_year FROM (SELECT DISTINCT year FROM (SELECT year FROM listings GROUP BY competitor_id, year HAVING count(*) > 8))"),
    "network_nodes": _sql("""SELECT p.year, p.competitor_id, coalesce(u.name_used, c.name) AS name, p.short_org AS org, CAST(dense_rank() OVER (PARTITION BY p.year ORDER BY p.short_org) - 1 AS INTEGER) AS "group", round(log10(p.n_bouts), 6) AS weight
FROM prim_then AS p JOIN competitors AS c USING (competitor_id) LEFT JOIN used_then AS u ON p.competitor_id = u.competitor_id AND p.year = u.year
WHERE c.in_cohort AND p.n_bouts >= 8 AND EXISTS (SELECT 1 FROM cohort_edges AS e WHERE e.dst = p.competitor_id AND e.year = p.year)"""),
    "network_links": _sql("""SELECT e.year, least(src, dst) AS source, greatest(src, dst) AS target, sum(e.n_bouts) AS n_listed, round(log10(sum(e.n_bouts)), 6) AS weight
FROM cohort_edges AS e JOIN prim AS a ON e.src = a.competitor_id AND e.year = a.year JOIN prim AS b ON e.dst = b.competitor_id AND e.year = b.year
JOIN competitors AS d ON e.dst = d.competitor_id WHERE d.in_cohort AND a.n_bouts >= 8 AND b.n_bouts >= 8 GROUP BY 1, 2, 3 HAVING sum(e.n_bouts) > 1"""),
    "glicko_period_terms": _sql(f"""SELECT period, id AS competitor_id, round(1 / (count(*) * {_G} * {_G} * 0.25), 6) AS v, round(sum({_G} * (score - 0.5)) / (count(*) * {_G} * {_G} * 0.25), 6) AS delta
FROM (SELECT strftime(bout_date, '%Y-%m') AS period, a AS id, CASE WHEN is_victory THEN 1.0 ELSE 0.5 END AS score FROM singles
      UNION ALL SELECT strftime(bout_date, '%Y-%m'), b, CASE WHEN is_victory THEN 0.0 ELSE 0.5 END FROM singles) GROUP BY 1, 2"""),
    "mixed_features": _sql(
        "SELECT feature, value, n_mixed, n_cohort_only, round(n_mixed / (n_mixed + n_cohort_only), 6) AS mixed_share FROM (SELECT feature, value, count(*) FILTER (WHERE mixed) AS n_mixed, count(*) FILTER (WHERE NOT mixed) AS n_cohort_only FROM ("
        + " UNION ALL ".join(f"SELECT mixed, '{n}' AS feature, {e} AS value FROM mixes" for n, e in (("size", "CAST(size AS VARCHAR)"), ("type", "CASE WHEN len(s0) = 1 AND len(s1) = 1 THEN 'singles' WHEN len(s0) = 2 AND len(s1) = 2 THEN 'tag_team' ELSE 'other_two_sided' END"), ("multi_sided", "'false'"), ("org", "org"), ("country", "country"), ("year", "CAST(year AS VARCHAR)")))
        + ") GROUP BY 1, 2)"
    ),
    "mixed_by_year_ma": _sql("""SELECT year, n_bouts, n_mixed, round(n_mixed / n_bouts, 6) AS mixed_share,
CASE WHEN count(*) OVER w = 3 THEN round(sum(n_mixed) OVER w / sum(n_bouts) OVER w, 6) END AS smoothed_share
FROM (SELECT year, count(*) AS n_bouts, count(*) FILTER (WHERE mixed) AS n_mixed FROM mixes GROUP BY year) WINDOW w AS (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""),
    "mixed_probability": _sql("SELECT bout_id, size, round(probability, 6) AS probability FROM scored"),
    "confidence": _sql("SELECT *, CASE WHEN confidence >= 0.95 THEN 'very high' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'moderate' WHEN confidence >= 0.3 THEN 'low' ELSE 'very low' END AS label FROM guessed"),
    "missing_features": _sql("SELECT subject_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FEATURES) + " FROM vectors WHERE subject_id NOT IN (SELECT competitor_id FROM competitors)"),
    "rule_precision": _sql(
        "SELECT rule, tp AS true_positives, fp AS false_positives, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN n > 0 THEN round(tp / n, 6) END AS recall FROM ("
        + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE ({e}) AND in_cohort) AS tp, count(*) FILTER (WHERE ({e}) AND NOT in_cohort) AS fp, count(*) FILTER (WHERE in_cohort) AS n FROM known" for n, e in _RULES)
        + ")"
    ),
    "feature_summary": _sql(
        "SELECT feature, in_cohort, count(*) AS n, round(avg(value), 6) AS mean, round(list_sort(list(value))[count(*) // 2 + 1], 6) AS upper_median, round(avg((value <> 0)::INT), 6) AS non_zero_share FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, in_cohort, {c} AS value FROM known" for c in _FEATURES)
        + ") GROUP BY 1, 2"
    ),
    "reclassify": _sql("SELECT c.competitor_id, c.diverse, c.in_cohort AS was_in_cohort, CASE WHEN c.diverse THEN s.cohort_share > 0.5 ELSE c.in_cohort END AS in_cohort FROM competitors AS c JOIN shares AS s USING (competitor_id)"),
    "team_counts": _sql("SELECT org, size, team, n_bouts FROM teams"),
    "team_ends": _sql(
        " UNION ALL ".join(f"SELECT org, size, '{e}' AS \"end\", r AS rank, team, n_bouts FROM (SELECT *, row_number() OVER (PARTITION BY org, size ORDER BY n_bouts {d}, members) AS r FROM teams) WHERE r <= 10" for e, d in (("top", "DESC"), ("bottom", "ASC")))
    ),
    "partners": _sql("""SELECT org, member, count(*) AS n_partners, sum(n_bouts) AS appearances, string_agg(partner || ':' || n_bouts, ',' ORDER BY r) FILTER (WHERE r <= 5) AS best_partners
FROM (SELECT *, row_number() OVER (PARTITION BY org, member ORDER BY n_bouts DESC, partner) AS r FROM pairs) GROUP BY 1, 2"""),
    "never_partners": _sql("""SELECT a.org, a.competitor_id AS member, s.n AS n_active, count(p.partner) AS n_met, s.n - 1 - count(p.partner) AS n_never
FROM active AS a JOIN (SELECT org, count(*) AS n FROM active GROUP BY org) AS s ON a.org = s.org
LEFT JOIN (SELECT p.* FROM pairs AS p JOIN active AS x ON p.org = x.org AND p.partner = x.competitor_id) AS p ON p.org = a.org AND p.member = a.competitor_id GROUP BY 1, 2, 3"""),
    "possible_teams": _sql("SELECT org, count(*) AS n_active, count(*) * (count(*) - 1) // 2 AS pairs, count(*) * (count(*) - 1) * (count(*) - 2) // 6 AS trios FROM active GROUP BY org"),
    "side_overlap": _sql("SELECT bout_id, bout_date, array_to_string(list_sort(list_intersect(s0, s1)), ',') AS on_both_sides, CAST(len(list_intersect(s0, s1)) AS INTEGER) AS n_both FROM bouts WHERE len(list_intersect(s0, s1)) > 0"),
    "quality_issues": _sql(" UNION ALL ".join(f"SELECT '{n}' AS issue, org, count(*) FILTER (WHERE {e}) AS n_bouts, round(avg(({e})::INT), 6) AS share FROM bouts GROUP BY org" for n, e in _ISSUES.items())),
    "profile_totals": _sql("SELECT c.country, count(*) AS n, count(*) FILTER (WHERE c.in_cohort) AS n_cohort, count(l.competitor_id) AS n_listed, count(*) FILTER (WHERE name <> '') AS n_named, round((count(*) FILTER (WHERE c.in_cohort)) / count(*), 6) AS cohort_share FROM competitors AS c LEFT JOIN (SELECT DISTINCT competitor_id FROM listings) AS l USING (competitor_id) GROUP BY 1"),
    "coverage": _sql("SELECT year, count(DISTINCT competitor_id) AS n_with_data, (SELECT count(*) FROM competitors WHERE in_cohort) AS n_cohort, round(count(DISTINCT competitor_id) / (SELECT count(*) FROM competitors WHERE in_cohort), 6) AS share FROM listings WHERE in_cohort GROUP BY year"),
    "freshness": _sql("SELECT in_cohort, count(*) AS n, count(age) AS n_updated, round(avg(age), 5) AS mean_age, round(list_sort(list(age) FILTER (WHERE age IS NOT NULL))[count(age) // 2 + 1], 5) AS upper_median_age, round(min(age), 5) AS newest_age, round(max(age), 5) AS oldest_age FROM aged GROUP BY in_cohort"),
    "stub_seed": _sql("""SELECT c.competitor_id, CAST(y.year AS INTEGER) AS year, CAST(0 AS BIGINT) AS n_bouts, TIMESTAMP '2022-07-01 00:00:00' AS last_updated FROM competitors AS c CROSS JOIN (SELECT unnest(range(1993, 2003)) AS year) AS y
WHERE NOT EXISTS (SELECT 1 FROM listings AS l WHERE l.competitor_id = c.competitor_id AND l.year = y.year)"""),
    "name_search": _sql("SELECT competitor_id, name, in_cohort FROM competitors WHERE contains(lower(name), 'r#0000000') ORDER BY CASE WHEN lower(name) = 'r#0000000' THEN 0 ELSE 1 END, name, competitor_id LIMIT 50"),
    "importance": _sql("SELECT competitor_id, n_bouts, coalesce(n_opponents, 0) AS n_opponents, importance FROM importances"),
    "refresh_plan": _sql(f"SELECT * FROM {_plan()}"),
    "session_items": _sql(f"SELECT * FROM {_plan()} ORDER BY priority, stage, object_id, year NULLS FIRST, operation LIMIT 40"),
    "plan_modes": _sql(f"SELECT *, 'force' AS mode FROM {_plan(force=True)} UNION ALL SELECT *, 'only_bouts' FROM {_plan(only_bouts=True)} UNION ALL SELECT *, 'transition' FROM {_plan(january=True)}"),
    "plan_stats": _sql(f"""SELECT CAST(grouping(operation, decade, year) AS BIGINT) AS level, operation, decade, year, count(*) AS n_items, count(DISTINCT object_id) AS n_objects
FROM (SELECT operation, CAST(floor(priority / 10) * 10 AS INTEGER) AS decade, year, object_id FROM {_plan()}) GROUP BY GROUPING SETS ((operation), (decade), (year), ())"""),
    "anniversaries": _sql("""SELECT competitor_id, debut, CAST(2024 - year(debut) AS INTEGER) AS years, a AS anniversary FROM (
SELECT competitor_id, min(bout_date) AS debut, make_date(2024, month(min(bout_date)), CASE WHEN month(min(bout_date)) = 2 AND day(min(bout_date)) = 29 THEN 28 ELSE day(min(bout_date)) END) AS a
FROM listings WHERE in_cohort GROUP BY 1) WHERE abs(date_diff('day', DATE '2024-02-20', a)) <= 60"""),
    "decades": _sql("SELECT CAST(floor(y / 10) * 10 AS INTEGER) AS decade, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT competitor_id, min(year) AS y FROM listings GROUP BY 1) GROUP BY 1"),
    "dossiers": _sql(f"""SELECT b.competitor_id, b.n_bouts, b.n_years, ye.c AS years, co.c AS countries, og.c AS orgs, o.t AS top_opponents, s.n_neighbours, s.cohort_share
FROM (SELECT competitor_id, count(*) AS n_bouts, count(DISTINCT year) AS n_years FROM listings GROUP BY 1) AS b
LEFT JOIN {_counter("listings", "year", "competitor_id")} AS ye USING (competitor_id) LEFT JOIN {_counter("listings", "country", "competitor_id")} AS co USING (competitor_id)
LEFT JOIN {_counter("listings", "org", "competitor_id")} AS og USING (competitor_id)
LEFT JOIN (SELECT src AS competitor_id, string_agg(dst || ':' || n, ',' ORDER BY n DESC, dst) AS t FROM (SELECT src, dst, count(*) AS n, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS r FROM edges GROUP BY 1, 2) WHERE r <= 10 GROUP BY 1) AS o USING (competitor_id)
LEFT JOIN shares AS s USING (competitor_id)"""),
    "missing_dossiers": _sql(f"""SELECT b.*, ye.c AS years, co.c AS countries, og.c AS orgs
FROM (SELECT subject_id, count(DISTINCT competitor_id) AS n_lists, count(*) AS n_rows, count(DISTINCT bout_id) AS n_bouts FROM lost GROUP BY 1) AS b
LEFT JOIN {_counter("lost", "year", "subject_id")} AS ye USING (subject_id) LEFT JOIN {_counter("lost", "country", "subject_id")} AS co USING (subject_id) LEFT JOIN {_counter("lost", "org", "subject_id")} AS og USING (subject_id)"""),
    "page_links": r"""SELECT page_id, CAST(position - 1 AS INTEGER) AS position, href, CASE WHEN trim(t) = '' THEN 'Unknown' ELSE trim(t) END AS text,
CASE regexp_extract(href, '(?:[?&]|&amp;)id=(\d+)', 1) WHEN '2' THEN 'competitor' WHEN '8' THEN 'organisation' WHEN '1' THEN 'event' WHEN '28' THEN 'tag_team' WHEN '29' THEN 'stable' ELSE 'other' END AS kind,
TRY_CAST(regexp_extract(href, '(?:[?&]|&amp;)nr=(\d+)', 1) AS BIGINT) AS number FROM (
SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS t,
unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1)) + 1)) AS position FROM pages)""",
    "page_titles": r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title,
nullif(regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1), '') AS language FROM pages""",
    "page_urls": r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
regexp_extract(pair, '^([^=]*)', 1) AS parameter, regexp_extract(pair, '=(.*)$', 1) AS value FROM (
SELECT page_id, url, CASE WHEN len(q) = 0 THEN NULL ELSE unnest(CASE WHEN len(q) = 0 THEN [NULL] ELSE q END) END AS pair
FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '') AS q FROM pages))""",
}

#: Columns whose type the other engine widens (sums, lengths, row numbers), as the queries have them.
_TYPES = {
    "neighbours_reverse": {"n_bouts": "BIGINT"}, "missing_ids": {"appearances": "BIGINT"}, "missing_buckets": {"total": "BIGINT", "least": "BIGINT", "most": "BIGINT"},
    "outside_buckets": {"total": "BIGINT"}, "workload_by_org": {"total": "BIGINT"}, "year_stats": {"n_bouts": "BIGINT", "cohort_bouts": "BIGINT"}, "network_links": {"n_listed": "BIGINT"},
    "mixed_probability": {"size": "INTEGER"}, "team_counts": {"size": "INTEGER"}, "team_ends": {"size": "INTEGER", "rank": "INTEGER"}, "partners": {"appearances": "BIGINT"},
}
for _name, _columns in _TYPES.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in _columns.items())}) FROM ({SQL[_name]})"


from boutflow import oracle_kept, oracle_store  # noqa: E402, F401  add more
