"""The queries of ``workload.queries`` as plain SQL.

Regressions are checked against the full dummy-variable normal equations, solved by elimination in a recursive query, so
the SQL shares no shortcut with the operators.
"""

from __future__ import annotations

from workload.queries import GAPPED_PARTIALS, PARTIALS, PERIODS, PRIORITIES

ORACLES: dict[str, str] = {}

SHIP = """
ship_rows AS (
  SELECT *, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem),
ship AS (
  SELECT year, month, sum(l_quantity) AS rfh,
         CAST(sum(cents) AS DOUBLE) / count(cents) / 99991 AS temperature
  FROM ship_rows GROUP BY year, month),
ship_nation AS (
  SELECT s_nationkey AS nation, year, month, sum(l_quantity) AS rfh,
         CAST(sum(cents) AS DOUBLE) / count(cents) / 99991 AS temperature
  FROM ship_rows LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""

ORD = """
order_rows AS (
  SELECT *, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month FROM orders),
ord AS (SELECT year, month, count(*) AS incidents FROM order_rows GROUP BY ALL),
ord_nation AS (
  SELECT c_nationkey AS nation, year, month, count(*) AS incidents
  FROM order_rows LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
urgent_nation AS (
  SELECT c_nationkey AS nation, year, month, count(*) AS incidents
  FROM order_rows LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)"""


def z(col: str, by: str = "") -> str:
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"(({col}) - avg({col}) {over}) / nullif(stddev_samp({col}) {over}, 0)"


def flag(d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN 'Above' WHEN {d} IS NOT NULL THEN 'Below' END"


def r(*columns: str) -> str:
    """Select list with rounded doubles."""
    return ", ".join(f"round({c} * 1e6) / 1e6 + 0.0 AS {c}" for c in columns)


def p_value(t: str, df: str) -> str:
    """P(|T| > |t|): the finite sums for odd and for even degrees of freedom."""
    angle, root = f"atan(abs({t}) / sqrt({df}))", f"cos(atan(abs({t}) / sqrt({df})))"
    odd = f"lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow({root}, 2 * j + 1)"
    even = f"lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow({root}, 2 * j)"
    return f"""CASE WHEN {df} <= 0 OR {t} IS NULL THEN NULL
      WHEN {df} % 2 = 1 THEN 1 - 2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), {odd})), 0))
      ELSE 1 - sin({angle}) * list_sum(list_transform(range(0, {df} // 2), {even})) END"""


def national(scale_by: str, incidents: str = "ord", extra: str = "") -> str:
    """CTEs ending in ``panel``: three deviations by month, rescaled by ``scale_by`` ('' for the whole table).

    ``incidents`` names the table of counts, which ``extra`` CTEs may define.
    """
    return f"""{SHIP}, {ORD},{extra}
rain_dev AS (SELECT year, month, rfh - avg(rfh) OVER (PARTITION BY month) AS rainfall_deviation FROM ship),
temp_dev AS (SELECT year, month, temperature - avg(temperature) OVER (PARTITION BY month) AS temperature_deviation FROM ship),
inc_z AS (SELECT year, month, {z('incidents', 'year')} AS s FROM {incidents}),
inc_dev AS (SELECT year, month, s - avg(s) OVER (PARTITION BY month) AS incident_deviation FROM inc_z),
merged AS (
  SELECT * FROM rain_dev JOIN inc_dev USING (year, month) JOIN temp_dev USING (year, month)),
panel AS (
  SELECT *, {z('rainfall_deviation', scale_by)} AS scaled_rainfall_deviation,
         {z('incident_deviation', scale_by)} AS scaled_incident_deviation,
         {z('temperature_deviation', scale_by)} AS scaled_temperature_deviation
  FROM merged)"""


def unit_anomalies(unit: str, ship: str, urgent: str) -> str:
    """CTEs ``rain_dev`` and ``inc_dev`` of one geographic level."""
    return f"""
rain_dev AS (
  SELECT {unit}, year, month, rfh, avg(rfh) OVER w AS mean_rfh, rfh - avg(rfh) OVER w AS rainfall_deviation
  FROM {ship} WINDOW w AS (PARTITION BY {unit}, month)),
filled AS (
  SELECT s.{unit}, s.year, s.month, coalesce(u.incidents, 0) AS incidents
  FROM {ship} s LEFT JOIN {urgent} u USING ({unit}, year, month) WHERE s.year >= 1996),
inc_z AS (SELECT *, {z('incidents', 'year')} AS standardized_incidents FROM filled),
inc_dev AS (
  SELECT {unit}, year, month, standardized_incidents,
         avg(standardized_incidents) OVER w AS mean_standardized_incidents,
         standardized_incidents - avg(standardized_incidents) OVER w AS incident_deviation
  FROM inc_z WINDOW w AS (PARTITION BY {unit}, month))"""


UNIT = f"""{SHIP}, {ORD}, {unit_anomalies('nation', 'ship_nation', 'ord_nation')},
temp_dev AS (
  SELECT nation, year, month, temperature, avg(temperature) OVER (PARTITION BY nation, month) AS mean_temperature,
         temperature - avg(temperature) OVER (PARTITION BY nation, month) AS temperature_deviation
  FROM ship_nation),
merged AS (
  SELECT * FROM rain_dev JOIN inc_dev USING (nation, year, month) LEFT JOIN temp_dev USING (nation, year, month)),
panel AS (
  SELECT *, make_date(year, month, 1) AS date,
         CAST(dense_rank() OVER (ORDER BY year, month) AS INT) AS time,
         {z('rainfall_deviation')} AS scaled_rainfall_deviation,
         {z('incident_deviation')} AS scaled_incident_deviation,
         {z('temperature_deviation')} AS scaled_temperature_deviation
  FROM merged)"""

SCALED = ["scaled_rainfall_deviation", "scaled_incident_deviation", "scaled_temperature_deviation"]

MODEL = """
m AS (
  SELECT row_number() OVER () AS i, scaled_incident_deviation AS y, scaled_rainfall_deviation AS x1,
         scaled_temperature_deviation AS x2, * EXCLUDE (rainfall_deviation, incident_deviation, temperature_deviation)
  FROM panel
  WHERE year <> 2001 AND scaled_incident_deviation IS NOT NULL AND scaled_rainfall_deviation IS NOT NULL
    AND scaled_temperature_deviation IS NOT NULL)"""


def solved(design: str) -> str:
    """CTEs solving the normal equations of the long design ``d(i, c, v)``: ``beta``, ``inv``, ``fit``."""
    return f"""
d AS ({design}),
cols AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT c FROM d)),
size AS (SELECT count(*) AS n FROM cols),
g AS (SELECT a.c AS ca, b.c AS cb, sum(a.v * b.v) AS s FROM d a JOIN d b USING (i) GROUP BY ALL),
rhs AS (SELECT c, sum(d.v * m.y) AS s FROM d JOIN m USING (i) GROUP BY c),
aug AS (
  SELECT a.k AS i,
         list_concat(list_concat(list(coalesce(g.s, 0.0) ORDER BY b.k), [any_value(rhs.s)]),
                     list(CASE WHEN a.k = b.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY b.k)) AS line
  FROM cols a CROSS JOIN cols b LEFT JOIN g ON g.ca = a.c AND g.cb = b.c JOIN rhs ON rhs.c = a.c GROUP BY a.k),
gj AS (
  SELECT 0::BIGINT AS step, i, line FROM aug
  UNION ALL
  SELECT q.step + 1, q.i,
         CASE WHEN q.i = p.i THEN list_transform(p.line, lambda v: v / p.line[p.i])
              ELSE list_transform(list_zip(q.line, p.line), lambda v: v[1] - q.line[p.i] / p.line[p.i] * v[2]) END
  FROM gj q JOIN gj p ON p.step = q.step AND p.i = q.step + 1 WHERE q.step < (SELECT n FROM size)),
done AS (SELECT cols.c, cols.k, gj.line, size.n FROM gj JOIN cols ON gj.i = cols.k CROSS JOIN size WHERE gj.step = size.n),
beta AS (SELECT c, k, line[n + 1] AS b, line[n + 1 + k] AS inv, line, n FROM done),
fit AS (
  SELECT (SELECT count(*) FROM m) - (SELECT n FROM size) AS df,
         ((SELECT sum(y * y) FROM m) - (SELECT sum(beta.b * rhs.s) FROM beta JOIN rhs USING (c))) AS rss,
         (SELECT count(*) FROM m) AS n_obs)"""


def dummies(*factors: str) -> str:
    """Long dummy design: all levels of the first factor, all but the first of the others."""
    parts = ["SELECT i, 'x1' AS c, x1 AS v FROM m", "SELECT i, 'x2', x2 FROM m"]
    for at, f in enumerate(factors):
        drop = f" WHERE {f} <> (SELECT min({f}) FROM m)" if at else ""
        parts.append(f"SELECT i, '{f}:' || {f}, 1.0::DOUBLE FROM m{drop}")
    return " UNION ALL ".join(parts)


def coefficient_query(panel: str, factors: tuple[str, ...], extra: str = "") -> str:
    return f"""WITH RECURSIVE {panel}, {MODEL}, {solved(dummies(*factors))},
centred AS (SELECT y - avg(y) OVER (PARTITION BY {factors[0]}) AS yc FROM m),
t AS (
  SELECT CASE c WHEN 'x1' THEN 'scaled_rainfall_deviation' ELSE 'scaled_temperature_deviation' END AS term,
         b AS estimate, sqrt(rss / df * inv) AS std_error, b / sqrt(rss / df * inv) AS t_value, df AS df_resid, n_obs,
         1 - rss / (SELECT sum(yc * yc) FROM centred) AS r_squared,
         b - 2 * sqrt(rss / df * inv) AS lower, b + 2 * sqrt(rss / df * inv) AS upper
  FROM beta CROSS JOIN fit WHERE c IN ('x1', 'x2')),
tp AS (SELECT *, {p_value('t_value', 'df_resid')} AS p_value FROM t)
SELECT term, df_resid, n_obs, {r('estimate', 'std_error', 't_value', 'p_value', 'lower', 'upper', *([extra] if extra else []))} FROM tp"""


ORACLES["monthly_strict_sum"] = f"""WITH {SHIP}, v AS (
  SELECT year, month, CASE WHEN l_quantity = 50 AND l_tax = 0.08::DOUBLE AND l_linenumber = 7 THEN NULL ELSE l_quantity END AS q FROM ship_rows)
SELECT year, month, CASE WHEN count(q) = count(*) THEN sum(q) END AS rfh FROM v GROUP BY ALL"""
ORACLES["monthly_skip_sum"] = f"""WITH {SHIP}
SELECT l_suppkey, year, month, coalesce(sum(l_quantity) FILTER (WHERE l_quantity > 45), 0) AS rfh FROM ship_rows GROUP BY ALL"""
ORACLES["monthly_mean"] = f"""WITH {SHIP}, t AS (
  SELECT l_suppkey, month, avg(CASE WHEN l_quantity > 45 THEN l_quantity END) AS mean_rfh FROM ship_rows GROUP BY ALL)
SELECT l_suppkey, month, {r('mean_rfh')} FROM t"""
ORACLES["monthly_count"] = f"WITH {ORD} SELECT year, month, incidents FROM ord"
ORACLES["monthly_through_supplier"] = f"WITH {SHIP} SELECT nation, year, month, rfh, {r('temperature')} FROM ship_nation"
ORACLES["agg_levels"] = f"""WITH {SHIP}
SELECT CASE WHEN grouping(nation) = 0 THEN 'unit' WHEN grouping(n_regionkey) = 0 THEN 'parent' ELSE 'total' END AS level,
       n_regionkey AS region, nation, year, month, sum(rfh) AS rfh
FROM ship_nation JOIN nation n ON ship_nation.nation = n_nationkey
GROUP BY GROUPING SETS ((year, month), (year, month, n_regionkey), (year, month, n_regionkey, nation))"""

ORACLES["month_deviation"] = f"""WITH {SHIP}, t AS (
  SELECT year, month, rfh, avg(rfh) OVER (PARTITION BY month) AS mean_rfh, rfh - avg(rfh) OVER (PARTITION BY month) AS rainfall_deviation FROM ship)
SELECT year, month, rfh, {flag('rainfall_deviation')} AS above_below_avg, {r('mean_rfh', 'rainfall_deviation')} FROM t"""
ORACLES["unit_month_deviation"] = f"""WITH {SHIP}, t AS (
  SELECT nation, year, month, rfh, avg(rfh) OVER w AS mean_rfh, rfh - avg(rfh) OVER w AS deviation
  FROM ship_nation WINDOW w AS (PARTITION BY nation, month))
SELECT nation, year, month, rfh, {flag('deviation')} AS above_below_avg, {r('mean_rfh', 'deviation')} FROM t"""
ORACLES["zscore_by_year"] = f"""WITH {ORD}, t AS (SELECT *, {z('incidents', 'year')} AS standardized_incidents FROM ord_nation)
SELECT nation, year, month, incidents, {r('standardized_incidents')} FROM t"""
ORACLES["zscore_by_month"] = f"""WITH {ORD}, t AS (SELECT *, {z('incidents', 'month')} AS standardized_incidents FROM ord)
SELECT year, month, incidents, {r('standardized_incidents')} FROM t"""
ORACLES["zscore_global"] = f"""WITH {SHIP}, t AS (
  SELECT *, {z('rfh')} AS scaled_rfh, {z('temperature')} AS scaled_temperature FROM ship)
SELECT year, month, rfh, {r('temperature', 'scaled_rfh', 'scaled_temperature')} FROM t"""


def standardised(source: str, by: str, keys: str, out: str) -> str:
    return f"""WITH {ORD}, a AS (SELECT *, {z('incidents', 'year')} AS standardized_incidents FROM {source}),
t AS (
  SELECT *, avg(standardized_incidents) OVER w AS mean_standardized_incidents,
         standardized_incidents - avg(standardized_incidents) OVER w AS {out} FROM a WINDOW w AS (PARTITION BY {by}))
SELECT {keys}, incidents, {r('standardized_incidents', 'mean_standardized_incidents', out)} FROM t"""


ORACLES["standardised_month_deviation"] = standardised("ord", "month", "year, month", "incident_deviation")
ORACLES["standardised_unit_deviation"] = standardised("ord_nation", "nation, month", "nation, year, month", "deviation")
ORACLES["period_index_by_month"] = f"""WITH {ORD}
SELECT nation, year, month, make_date(year, month, 1) AS date, CAST(dense_rank() OVER (ORDER BY year, month) AS INT) AS time,
       monthname(make_date(year, month, 1)) AS month_name FROM ord_nation"""

ORACLES["unpivot_matching_columns"] = f"""WITH {SHIP}, months AS (SELECT DISTINCT year, month FROM ship_nation),
nations AS (SELECT DISTINCT nation FROM ship_nation)
SELECT nation, year, month, {r('temperature')} FROM nations CROSS JOIN months LEFT JOIN ship_nation USING (nation, year, month)"""
ORACLES["unpivot_between_columns"] = f"""WITH {ORD}, cells AS (
  SELECT DISTINCT nation, year, CAST(m AS INT) AS month FROM ord_nation CROSS JOIN range(1, 13) b(m))
SELECT nation, year, month, incidents FROM cells LEFT JOIN ord_nation USING (nation, year, month)"""
ORACLES["complete_month_grid"] = f"""WITH {ORD}, u AS (
  SELECT year, month, count(*) AS incidents FROM order_rows GROUP BY ALL),
months AS (SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM range(1996, 2003) a(y) CROSS JOIN range(1, 13) b(m))
SELECT year, month, coalesce(incidents, 0) AS incidents FROM u FULL JOIN months USING (year, month)"""

ORACLES["zero_filled_skeleton"] = f"""WITH {SHIP}, {ORD}
SELECT nation, year, month, coalesce(incidents, 0) AS incidents
FROM ship_nation LEFT JOIN ord_nation USING (nation, year, month) WHERE year >= 1996"""
ORACLES["spliced_series"] = f"""WITH {SHIP}, {ORD}
SELECT year, month, incidents AS total FROM ord WHERE year < 1998
UNION ALL SELECT year, month, count(*) FROM ship_rows GROUP BY ALL"""
ORACLES["merged_panel"] = f"""WITH {SHIP}, {ORD}
SELECT nation, year, month, rfh, o.incidents, u.incidents AS urgent FROM ship_nation JOIN ord_nation o USING (nation, year, month)
LEFT JOIN urgent_nation u USING (nation, year, month)"""
_codes = ", ".join(f"('{a}', '{b}')" for a, b in PRIORITIES)
ORACLES["inline_lookup"] = f"""WITH {ORD}, codes(priority, code) AS (VALUES {_codes})
SELECT code, year, month, count(*) AS total FROM order_rows LEFT JOIN codes ON o_orderpriority = priority GROUP BY ALL"""
ORACLES["table_lookup"] = f"""WITH {ORD}
SELECT o_orderkey, year, count(*) AS orders, c_name FROM order_rows LEFT JOIN customer ON o_orderkey = c_custkey GROUP BY o_orderkey, year, c_name"""
ORACLES["folded_lookup"] = """WITH c AS (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY ALL)
SELECT 'Nationé' || c_nationkey AS key, customers, n_regionkey FROM c LEFT JOIN nation ON n_name = 'NATION_' || c_nationkey"""
ORACLES["lookup_fan_out"] = f"""WITH {SHIP}
SELECT n_name, n_nationkey, year, month, rfh FROM nation LEFT JOIN ship_nation s ON n_nationkey = s.nation"""
ORACLES["unmatched_lookup_keys"] = f"""WITH codes(priority, code) AS (VALUES {_codes})
SELECT o_orderpriority, count(*) AS rows FROM orders WHERE o_orderpriority NOT IN (SELECT priority FROM codes) GROUP BY ALL"""
_periods = ", ".join(f"({i}, '{name}', {lo}, {hi})" for i, (name, lo, hi) in enumerate(PERIODS, 1))
PROFILE = f"""periods(period_ord, period, lo, hi) AS (VALUES {_periods}),
prof AS (
  SELECT period_ord, period, month, avg(rfh) AS mean_rfh FROM ship JOIN periods ON year BETWEEN lo AND hi GROUP BY ALL)"""
ORACLES["period_profile_means"] = f"WITH {SHIP}, {PROFILE} SELECT period_ord, period, month, {r('mean_rfh')} FROM prof"
ORACLES["recent_profile_means"] = f"""WITH {SHIP}, t AS (
  SELECT nation, month, avg(rfh) AS mean_rfh, avg(temperature) AS mean_temperature
  FROM ship_nation WHERE year >= 1999 AND year < 2001 GROUP BY ALL)
SELECT nation, month, {r('mean_rfh', 'mean_temperature')} FROM t"""

ORACLES["text_keep_drop"] = """SELECT p_partkey, p_name FROM part
WHERE regexp_matches(p_name, 'widget|bolt|anvil') AND NOT regexp_matches(p_name, 'red|small')"""
ORACLES["legacy_text"] = """SELECT p_partkey, translate(p_name, 'ae', 'áé') AS text,
  lower(regexp_replace(translate(p_name, 'ae', '__'), '[^A-Za-z0-9]', '_', 'g')) AS folded FROM part"""
ORACLES["date_parsing"] = """WITH t AS (
  SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS date_dmy,
         CAST(o_orderdate AS DATE) AS date_mdy FROM orders)
SELECT o_orderkey, date_dmy, date_mdy, CAST(year(date_dmy) AS INT) AS year, CAST(month(date_dmy) AS INT) AS month FROM t"""
ORACLES["administrative_codes"] = """SELECT s_suppkey, 'CO' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS code,
  s_nationkey AS parent_code, CAST(s_nationkey * 10000000 + s_suppkey AS INT) AS unit_code FROM supplier"""

ORACLES["range_profile"] = """WITH spans AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + CAST(o_custkey % 10 AS INT) AS hi FROM orders)
SELECT o_orderkey, count(*) AS shipments, sum(l_quantity) AS rfh FROM spans JOIN lineitem ON CAST(l_shipdate AS DATE) BETWEEN lo AND hi GROUP BY o_orderkey"""
ORACLES["range_profile_by_supplier"] = f"""WITH {SHIP}, cells AS (SELECT l_suppkey, year * 12 + month AS mo, sum(l_quantity) AS rfh FROM ship_rows GROUP BY ALL),
spans AS (SELECT l_suppkey, mo AS lo, mo + l_suppkey % 14 - 1 AS hi FROM cells),
t AS (SELECT s.l_suppkey, lo, avg(rfh) AS mean_rfh, count(*) AS months FROM spans s JOIN cells c ON s.l_suppkey = c.l_suppkey AND mo BETWEEN lo AND hi GROUP BY ALL)
SELECT l_suppkey, lo, months, {r('mean_rfh')} FROM t"""
ORACLES["skewed_lookup"] = """WITH lines AS (
  SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag || (CASE WHEN l_returnflag = 'A' THEN l_suppkey ELSE 0 END) END AS key FROM lineitem),
dim AS (SELECT 'A' || s_suppkey AS name, s_nationkey FROM supplier UNION ALL SELECT CASE WHEN n_regionkey = 0 THEN 'R0' END, n_nationkey FROM nation)
SELECT key, s_nationkey, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS sum_orderkey FROM lines LEFT JOIN dim ON key IS NOT DISTINCT FROM name GROUP BY ALL"""

ORACLES["fe_within_national"] = coefficient_query(national("month"), ("year",), "r_squared")
ORACLES["fe_within_units"] = coefficient_query(UNIT, ("year",), "r_squared")
ORACLES["absorb_year_month"] = coefficient_query(national(""), ("year", "month"))
ORACLES["absorb_unit_year"] = coefficient_query(UNIT, ("nation", "year"))
ORACLES["absorb_unit_year_rounds"] = ORACLES["absorb_unit_year"]
ORACLES["absorb_unit_year_month_rounds"] = coefficient_query(UNIT, ("nation", "month", "year"))
ORACLES["absorb_unit_year_month"] = coefficient_query(UNIT, ("nation", "year", "month"))

ORACLES["lm_year_month"] = ORACLES["absorb_year_month"]
# With near = x1 + x2 / 10000 the fit on x1 and x2 is the same; its coefficients are taken back to x1 and near.
ORACLES["lm_nearly_collinear"] = f"""WITH RECURSIVE {UNIT}, {MODEL}, {solved(dummies('year', 'month'))},
v AS (
  SELECT a.b AS b1, z.b AS b2, a.inv AS v1, z.inv AS v2, a.line[a.n + 1 + z.k] AS v12, rss / df AS s2, df, n_obs
  FROM beta a, beta z, fit WHERE a.c = 'x1' AND z.c = 'x2'),
e AS (
  SELECT 'scaled_rainfall_deviation' AS term, b1 - 10000 * b2 AS estimate, sqrt(s2 * (v1 + 1e8 * v2 - 20000 * v12)) AS std_error, df, n_obs FROM v
  UNION ALL SELECT 'near', 10000 * b2, sqrt(s2 * 1e8 * v2), df, n_obs FROM v),
t AS (SELECT term, df AS df_resid, n_obs, estimate / 100 AS estimate, std_error / 100 AS std_error, estimate / std_error AS t_value FROM e),
tp AS (SELECT *, {p_value('t_value', 'df_resid')} AS p_value FROM t)
SELECT term, df_resid, n_obs, {r('estimate', 'std_error', 't_value', 'p_value')} FROM tp"""

SLOPES = f"""{UNIT}, {MODEL}, {solved('''
SELECT i, 'x1:' || nation AS c, x1 AS v FROM m UNION ALL SELECT i, 'x2', x2 FROM m
UNION ALL SELECT i, 'nation:' || nation, 1.0::DOUBLE FROM m
UNION ALL SELECT i, 'year:' || year, 1.0::DOUBLE FROM m WHERE year <> (SELECT min(year) FROM m)''')},
ref AS (SELECT 'x1:' || min(nation) AS c FROM m),
refrow AS (SELECT beta.* FROM beta JOIN ref USING (c)),
slopes AS (
  SELECT CAST(substr(b.c, 4) AS INT) AS nation, b.b AS slope, sqrt(rss / df * b.inv) AS std_error,
         b.b / sqrt(rss / df * b.inv) AS t_value,
         CASE WHEN b.c <> q.c THEN b.b - q.b END AS slope_minus_ref,
         CASE WHEN b.c <> q.c THEN sqrt(rss / df * (b.inv + q.inv - 2 * b.line[b.n + 1 + q.k])) END AS diff_std_error, df AS df_resid
  FROM beta b CROSS JOIN refrow q CROSS JOIN fit WHERE b.c LIKE 'x1:%'),
slope_d AS (SELECT *, slope_minus_ref / diff_std_error AS diff_t_value FROM slopes),
slope_t AS (SELECT *, {p_value('t_value', 'df_resid')} AS p_value, {p_value('diff_t_value', 'df_resid')} AS diff_p_value FROM slope_d)"""
ORACLES["unit_slope_table"] = f"""WITH RECURSIVE {SLOPES}
SELECT nation, df_resid, {r('slope', 'std_error', 't_value', 'p_value', 'slope_minus_ref', 'diff_std_error', 'diff_t_value', 'diff_p_value')} FROM slope_t"""
ORACLES["slope_map"] = f"""WITH RECURSIVE {SLOPES}, t AS (
  SELECT n_nationkey AS nation, n_name, slope_minus_ref AS estimate, diff_std_error AS std_error, diff_p_value AS p_value,
         sign(slope_minus_ref) * sqrt(abs(slope_minus_ref)) AS estimate_sqrt
  FROM nation LEFT JOIN slope_t ON slope_t.nation = n_nationkey)
SELECT nation, n_name, {r('estimate', 'std_error', 'p_value', 'estimate_sqrt')} FROM t"""

# Autoregressive errors: every row is replaced by its prediction error from the rows before it (at most p), which the
# partial autocorrelations k1, k2, k3 give step by step, and the whitened rows go through plain least squares.
PREDICTION = {  # rows before -> coefficients of lags 1, 2, 3, and the scale
    0: ("0", "0", "0", "1"),
    1: ("k1", "0", "0", "sqrt(1 - k1*k1)"),
    2: ("(k1 - k2*k1)", "k2", "0", "sqrt((1 - k1*k1) * (1 - k2*k2))"),
    3: ("(k1 - k2*k1 - k3*k2)", "(k2 - k3*(k1 - k2*k1))", "k3", "sqrt((1 - k1*k1) * (1 - k2*k2) * (1 - k3*k3))"),
}


def whitened(column: str, p: int) -> str:
    cases = []
    for before in range(p + 1):
        c1, c2, c3, scale = PREDICTION[before]
        lags = "".join(f" - {c} * {column}_{i}" for i, c in ((1, c1), (2, c2), (3, c3)) if i <= before)
        cases.append(f"{'WHEN pos = ' + str(before + 1) + ' THEN' if before < p else 'ELSE'} ({column}{lags}) / ({scale})")
    return f"CASE {' '.join(cases)} END"


# Solves the 3 x 3 system of (intercept, x1, x2) per parameter row from the whitened columns a, b, c, y.
SOLVE3 = """
s AS (
  SELECT id, count(*) AS n, any_value(k1) AS k1, any_value(k2) AS k2, any_value(k3) AS k3, sum(2 * ln(scale)) AS logv,
         sum(a*a) aa, sum(a*b) ab, sum(a*c) ac, sum(b*b) bb, sum(b*c) bc, sum(c*c) cc, sum(a*y) ay, sum(b*y) by_, sum(c*y) cy, sum(y*y) yy
  FROM white GROUP BY id),
det AS (SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS dt FROM s),
inv AS (
  SELECT *, (bb*cc-bc*bc)/dt AS iaa, (ac*bc-ab*cc)/dt AS iab, (ab*bc-ac*bb)/dt AS iac,
         (aa*cc-ac*ac)/dt AS ibb, (ab*ac-aa*bc)/dt AS ibc, (aa*bb-ab*ab)/dt AS icc FROM det),
est AS (
  SELECT *, iaa*ay + iab*by_ + iac*cy AS intercept, iab*ay + ibb*by_ + ibc*cy AS e1, iac*ay + ibc*by_ + icc*cy AS e2 FROM inv),
res AS (SELECT *, (yy - intercept*ay - e1*by_ - e2*cy) / (n - 3) AS s2 FROM est),
solved AS (
  SELECT *, -0.5 * ((n - 3) * (ln(2 * pi() * s2) + 1) + logv + ln(dt)) AS log_lik, sqrt(s2) AS sigma,
         e1 AS scaled_rainfall_deviation, e2 AS scaled_temperature_deviation, sqrt(s2 * iaa) AS se_intercept,
         sqrt(s2 * ibb) AS se_scaled_rainfall_deviation, sqrt(s2 * icc) AS se_scaled_temperature_deviation FROM res)"""


def lagged(p: int) -> str:
    lags = ", ".join(f"lag({c}, {i}) OVER w AS {c}_{i}" for c in ("one", "x1", "x2", "y") for i in range(1, p + 1))
    return f"""
ones AS (SELECT month, year, 1.0::DOUBLE AS one, x1, x2, y FROM m),
lagged AS (SELECT *, {lags}, row_number() OVER w AS pos FROM ones WINDOW w AS (PARTITION BY month ORDER BY year))"""


def white(p: int) -> str:
    scale = "CASE " + " ".join(f"WHEN pos = {i + 1} THEN {PREDICTION[i][3]}" for i in range(p)) + f" ELSE {PREDICTION[p][3]} END"
    return f"""
white AS (
  SELECT id, k1, k2, k3, {scale} AS scale, {whitened('one', p)} AS a, {whitened('x1', p)} AS b, {whitened('x2', p)} AS c,
         {whitened('y', p)} AS y FROM lagged CROSS JOIN params)"""


for _p, _partials in PARTIALS.items():
    _rows = ", ".join("(" + ", ".join([str(i), *[f"{k}::DOUBLE" for k in (*partial, 0.0, 0.0)[:3]]]) + ")" for i, partial in enumerate(_partials))
    _phi = ", ".join(f"{c} AS phi_{i}" for i, c in enumerate(PREDICTION[_p][:_p], 1))
    _partial = ", ".join(f"k{i} AS partial_{i}" for i in range(1, _p + 1))
    ORACLES[f"gls_ar{_p}_profile"] = f"""WITH {national('month')}, {MODEL}, params(id, k1, k2, k3) AS (VALUES {_rows}), {lagged(_p)},{white(_p)}, {SOLVE3},
t AS (SELECT *, {_phi}, {_partial} FROM solved)
SELECT {r(*[f'{kind}_{i}' for kind in ('partial', 'phi') for i in range(1, _p + 1)], 'log_lik', 'sigma', 'intercept', 'scaled_rainfall_deviation',
          'scaled_temperature_deviation', 'se_intercept', 'se_scaled_rainfall_deviation', 'se_scaled_temperature_deviation')} FROM t"""

# The maximum itself: a grid around the best point so far, halved 28 times.
for _p in (1, 2, 3):
    _axis = lambda i: f"CROSS JOIN range(-3, 4) o{i}(d{i})" if i <= _p else ""
    _at = lambda i: f"greatest(-0.999, least(0.999, k{i} + d{i} * w))" if i <= _p else "0.0::DOUBLE"
    _phi = ", ".join(f"{c} AS phi_{i}" for i, c in enumerate(PREDICTION[_p][:_p], 1))
    _term = lambda name, value, error: f"SELECT '{name}' AS term, {value} AS estimate, {error} AS std_error, * FROM final"
    _values = ["estimate", "std_error", "t_value", "p_value", "lower", "upper", "sigma", "log_lik", *[f"phi_{i}" for i in range(1, _p + 1)]]
    ORACLES[f"gls_ar{_p}"] = f"""WITH RECURSIVE {national('month')}, {MODEL}, {lagged(_p)},
search AS (
  SELECT 0 AS step, 0.3::DOUBLE AS w, 0.0::DOUBLE AS k1, 0.0::DOUBLE AS k2, 0.0::DOUBLE AS k3
  UNION ALL
  SELECT step + 1, w / 2, best.k1, best.k2, best.k3 FROM (
    WITH params AS (
      SELECT step, w, row_number() OVER () AS id, {_at(1)} AS k1, {_at(2)} AS k2, {_at(3)} AS k3
      FROM search {_axis(1)} {_axis(2)} {_axis(3)} WHERE step < 28),
    {white(_p)}, {SOLVE3}
    SELECT any_value(params.step) AS step, any_value(params.w) AS w,
           arg_max({{'k1': params.k1, 'k2': params.k2, 'k3': params.k3}}, solved.log_lik) AS best
    FROM solved JOIN params USING (id)) q WHERE step IS NOT NULL),
params AS (SELECT 1 AS id, k1, k2, k3 FROM search WHERE step = 28), {white(_p)}, {SOLVE3},
final AS (SELECT *, {_phi} FROM solved),
terms AS (
  {_term('(Intercept)', 'intercept', 'se_intercept')} UNION ALL
  {_term('scaled_rainfall_deviation', 'scaled_rainfall_deviation', 'se_scaled_rainfall_deviation')} UNION ALL
  {_term('scaled_temperature_deviation', 'scaled_temperature_deviation', 'se_scaled_temperature_deviation')}),
q AS (SELECT *, estimate / std_error AS t_value, n - 3 AS df, estimate - 2 * std_error AS lower, estimate + 2 * std_error AS upper FROM terms),
t AS (SELECT *, {p_value('t_value', 'df')} AS p_value FROM q)
SELECT term, n - 3 AS df_resid, n AS n_obs, {", ".join(f"round({c} * 1e4) / 1e4 + 0.0 AS {c}" for c in _values)} FROM t"""

# Irregular times: the correlation matrix of each series beside its columns (1, x1, x2, y), eliminated row by row. A pivot
# is the variance of a row given the rows before it, the pivot row's columns are its prediction errors.
for _p, _partials in GAPPED_PARTIALS.items():
    _rows = ", ".join("(" + ", ".join([str(i), *[f"{k}::DOUBLE" for k in (*partial, 0.0, 0.0)[:3]]]) + ")" for i, partial in enumerate(_partials))
    _phi = ", ".join(f"{c} AS phi_{i}" for i, c in enumerate(PREDICTION[_p][:_p], 1))
    _partial = ", ".join(f"k{i} AS partial_{i}" for i in range(1, _p + 1))
    _c1, _c2, _c3 = PREDICTION[3][:3]
    ORACLES[f"gls_ar{_p}_gapped"] = f"""WITH RECURSIVE {ORD},
cells AS (
  SELECT o_custkey AS unit, year * 12 + month AS t, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 9999991 AS y,
         CAST(count(*) AS DOUBLE) AS x1, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS x2
  FROM order_rows GROUP BY ALL),
params(id, k1, k2, k3) AS (VALUES {_rows}),
grown AS (
  SELECT id, k1, k2, k3, [1.0::DOUBLE, k1, (k1 - k2*k1)*k1 + k2] AS rho FROM params
  UNION ALL
  SELECT id, k1, k2, k3, list_append(rho, {_c1}*rho[len(rho)] + {_c2}*rho[len(rho)-1] + {_c3}*rho[len(rho)-2])
  FROM grown WHERE len(rho) <= (SELECT max(t) - min(t) FROM cells)),
rhos AS (SELECT * FROM grown WHERE len(rho) = (SELECT max(len(rho)) FROM grown)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) AS i, count(*) OVER (PARTITION BY unit) AS n FROM cells),
whole AS (SELECT unit, list(t ORDER BY t) AS ts FROM cells GROUP BY unit),
lines AS (
  SELECT 0::BIGINT AS step, id, unit, i, n,
         list_concat(list_transform(ts, lambda u: rho[CAST(abs(u - t) AS BIGINT) + 1]), [1.0::DOUBLE, x1, x2, y]) AS line
  FROM numbered JOIN whole USING (unit) CROSS JOIN rhos
  UNION ALL
  SELECT a.step + 1, a.id, a.unit, a.i, a.n, list_transform(a.line, lambda v, k: v - a.line[a.step + 1] / b.line[a.step + 1] * b.line[k])
  FROM lines a JOIN lines b ON a.id = b.id AND a.unit = b.unit AND b.i = a.step + 1 AND a.i > a.step + 1),
white AS (
  SELECT id, k1, k2, k3, sqrt(line[i]) AS scale, line[n+1] / sqrt(line[i]) AS a, line[n+2] / sqrt(line[i]) AS b,
         line[n+3] / sqrt(line[i]) AS c, line[n+4] / sqrt(line[i]) AS y
  FROM lines JOIN params USING (id) WHERE i = step + 1), {SOLVE3},
t AS (
  SELECT *, {_phi}, {_partial}, e1 AS orders, e2 AS urgent, se_scaled_rainfall_deviation AS se_orders,
         se_scaled_temperature_deviation AS se_urgent FROM solved)
SELECT {r(*[f'{kind}_{i}' for kind in ('partial', 'phi') for i in range(1, _p + 1)], 'log_lik', 'sigma', 'intercept', 'orders', 'urgent',
          'se_intercept', 'se_orders', 'se_urgent')} FROM t"""

LINE = """
  count(*) AS n, regr_slope(d, year) AS slope, regr_intercept(d, year) AS intercept, avg(year) AS x_mean, regr_sxx(d, year) AS sxx,
  CAST(min(year) AS DOUBLE) AS x_min, CAST(max(year) AS DOUBLE) AS x_max,
  CASE WHEN count(*) > 2 THEN sqrt(greatest(regr_syy(d, year) - regr_slope(d, year) * regr_sxy(d, year), 0) / (count(*) - 2)) END AS s"""
ORACLES["trend_line_fit"] = f"""WITH {SHIP}, v AS (
  SELECT nation, month, year, rfh - avg(rfh) OVER (PARTITION BY nation, month) AS d FROM ship_nation),
t AS (SELECT nation, month, {LINE} FROM v GROUP BY nation, month)
SELECT nation, month, n, {r('slope', 'intercept', 'x_mean', 'sxx', 'x_min', 'x_max', 's')} FROM t WHERE sxx > 0"""
# 97.5 % points of Student's t for 1 to 6 degrees of freedom, from printed tables.
BAND = f"""lines AS (SELECT month, {LINE} FROM v GROUP BY month),
points AS (
  SELECT *, x_min + k * ((x_max - x_min) / 79) AS x,
         CASE n - 2 WHEN 1 THEN 12.706204736174694 WHEN 2 THEN 4.302652729749462 WHEN 3 THEN 3.1824463052837078
           WHEN 4 THEN 2.7764451051977934 WHEN 5 THEN 2.5705818356363146 WHEN 6 THEN 2.446911851144969 END AS q
  FROM lines CROSS JOIN range(0, 80) g(k)),
b AS (SELECT *, intercept + slope * x AS fit, s * sqrt(1.0 / n + (x - x_mean) * (x - x_mean) / sxx) AS se FROM points),
band AS (SELECT *, fit - q * se AS lower, fit + q * se AS upper FROM b)"""
ORACLES["trend_band"] = f"""WITH {SHIP}, v AS (
  SELECT month, year, temperature - avg(temperature) OVER (PARTITION BY month) AS d FROM ship), {BAND}
SELECT month, {r('x', 'fit', 'se', 'lower', 'upper')} FROM band"""
ORACLES["incident_trends"] = f"""WITH {ORD}, a AS (SELECT *, {z('incidents', 'year')} AS s FROM ord),
w AS (SELECT month, year, s - avg(s) OVER (PARTITION BY month) AS d FROM a), v AS (SELECT * FROM w WHERE year >= 1996), {BAND}
SELECT month, monthname(make_date(2000, month, 1)) AS month_name, {r('x', 'fit', 'se', 'lower', 'upper')} FROM band"""


def kde(keys: str, weight: str, source: str) -> str:
    return f"""stats AS (
  SELECT {keys}, 0.6 * 0.9 * least(stddev_samp(month), (quantile_cont(month, 0.75) - quantile_cont(month, 0.25)) / 1.34)
           * pow(count(*), -0.2) AS bw, sum({weight}) AS total FROM {source} GROUP BY {keys}),
grid AS (SELECT 1.0 + k * (11.0::DOUBLE / 511) AS x FROM range(0, 512) g(k)),
density AS (
  SELECT {keys}, x, sum({weight} / total * exp(-0.5 * ((x - month) / bw) * ((x - month) / bw)) / (bw * sqrt(2 * pi()))) AS density
  FROM {source} JOIN stats USING ({keys}) CROSS JOIN grid GROUP BY {keys}, x)
SELECT {keys}, {r('x', 'density')} FROM density"""


ORACLES["weighted_density"] = f"WITH {ORD}, {kde('year', 'incidents', 'ord')}"
ORACLES["period_densities"] = f"WITH {SHIP}, {PROFILE}, {kde('period_ord, period', 'mean_rfh', 'prof')}"

PARCELS = """
corners(ring, seq, dx, dy) AS (VALUES (1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 1.0, 1.0), (1, 4, 0.0, 1.0), (1, 5, 0.0, 0.0),
  (2, 1, 0.25, 0.25), (2, 2, 0.25, 0.5), (2, 3, 0.75, 0.5), (2, 4, 0.25, 0.25)),
vertices AS (
  SELECT c_custkey AS unit, c_mktsegment AS parent, ring, seq,
         -75.0::DOUBLE + (c_custkey % 200 + dx::DOUBLE) / 61 AS lon, 4.0::DOUBLE + (c_custkey // 200 + dy::DOUBLE) / 61 AS lat
  FROM customer CROSS JOIN corners WHERE ring = 1 OR c_mktsegment = 'BUILDING'),
ends AS (
  SELECT unit, parent, lon AS x0, lat AS y0, lead(lon) OVER w AS x1, lead(lat) OVER w AS y1
  FROM vertices WINDOW w AS (PARTITION BY unit, ring ORDER BY seq)),
edges AS (SELECT * FROM ends WHERE x1 IS NOT NULL)"""
PLANAR = """sum(x0*y1 - x1*y0) AS a2, sum((x0 + x1 + 150) * ((x0+75)*(y1-4) - (x1+75)*(y0-4))) AS mx,
  sum((y0 + y1 - 8) * ((x0+75)*(y1-4) - (x1+75)*(y0-4))) AS my, sum((x0+75)*(y1-4) - (x1+75)*(y0-4)) AS a"""
ORACLES["planar_centroids"] = f"""WITH {PARCELS}, s AS (SELECT unit, {PLANAR} FROM edges GROUP BY unit),
t AS (SELECT unit, mx / (3 * a) - 75 AS lon, my / (3 * a) + 4 AS lat, abs(a) / 2 * 3721 AS area FROM s)
SELECT unit, {r('lon', 'lat', 'area')} FROM t"""
# Spherical: sums of edge angle times edge normal. Differences of directions by half-angle products, or the digits go.
ORACLES["spherical_centroids"] = f"""WITH {PARCELS}, h AS (
  SELECT unit, radians(x0 - x1) / 2 AS a, radians(y0 - y1) / 2 AS b, radians(x0 + x1) / 2 AS ma, radians(y0 + y1) / 2 AS mb,
         cos(radians(y0))*cos(radians(x0)) + cos(radians(y1))*cos(radians(x1)) AS sx,
         cos(radians(y0))*sin(radians(x0)) + cos(radians(y1))*sin(radians(x1)) AS sy, sin(radians(y0)) + sin(radians(y1)) AS sz
  FROM edges),
p AS (
  SELECT *, -sin(ma - mb) * sin(a - b) - sin(ma + mb) * sin(a + b) AS dx, cos(ma + mb) * sin(a + b) + cos(ma - mb) * sin(a - b) AS dy,
         2 * cos(mb) * sin(b) AS dz FROM h),
n AS (SELECT unit, (dy*sz - dz*sy) / 2 AS nx, (dz*sx - dx*sz) / 2 AS ny, (dx*sy - dy*sx) / 2 AS nz FROM p),
w AS (SELECT *, asin(sqrt(nx*nx + ny*ny + nz*nz)) / sqrt(nx*nx + ny*ny + nz*nz) AS k FROM n),
s AS (SELECT unit, sum(k*nx) AS x, sum(k*ny) AS y, sum(k*nz) AS zz FROM w GROUP BY unit),
t AS (SELECT unit, degrees(atan2(y, x)) AS lon, degrees(atan2(zz, sqrt(x*x + y*y))) AS lat FROM s)
SELECT unit, {r('lon', 'lat')} FROM t"""
OUTLINE = """keyed AS (
  SELECT *, CASE WHEN (x0, y0) < (x1, y1) THEN (x0, y0, x1, y1) ELSE (x1, y1, x0, y0) END AS k FROM edges),
outline AS (SELECT parent, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1
  FROM keyed GROUP BY parent, k HAVING count(*) = 1)"""
ORACLES["dissolved_edges"] = f"WITH {PARCELS}, {OUTLINE} SELECT parent, {r('x0', 'y0', 'x1', 'y1')} FROM outline"
ORACLES["edge_multiplicities"] = f"""WITH {PARCELS}, {OUTLINE}, c AS (SELECT parent, k, count(*) AS n FROM keyed GROUP BY ALL)
SELECT parent, count(*) FILTER (WHERE n = 1) AS outline, count(*) FILTER (WHERE n = 2) AS shared, count(*) FILTER (WHERE n > 2) AS overlapping
FROM c GROUP BY parent"""
ORACLES["dissolved_centroids"] = f"""WITH {PARCELS}, s AS (SELECT parent, {PLANAR} FROM edges GROUP BY parent),
t AS (SELECT parent, mx / (3 * a) - 75 AS lon, my / (3 * a) + 4 AS lat, abs(a) / 2 AS area FROM s)
SELECT parent, {r('lon', 'lat', 'area')} FROM t"""
# Rings: the next edge is the one turning least from the reversed edge; each ring is walked from its smallest edge.
ORACLES["outline_rings"] = f"""WITH RECURSIVE {PARCELS}, {OUTLINE},
e AS (SELECT *, row_number() OVER (ORDER BY parent, x0, y0, x1, y1) AS id FROM outline),
turns AS (
  SELECT a.id, b.id AS nxt, atan2(a.y0 - a.y1, a.x0 - a.x1) - atan2(b.y1 - b.y0, b.x1 - b.x0) AS turn
  FROM e a JOIN e b ON a.parent = b.parent AND a.x1 = b.x0 AND a.y1 = b.y0),
follow AS (SELECT id, arg_min(nxt, CASE WHEN turn < 1e-12 THEN turn + 2 * pi() ELSE turn END) AS nxt FROM turns GROUP BY id),
walk AS (
  SELECT id AS head, id, 1::BIGINT AS seq FROM e
  UNION ALL SELECT w.head, f.nxt, w.seq + 1 FROM walk w JOIN follow f USING (id) WHERE f.nxt > w.head),
heads AS (SELECT DISTINCT head FROM walk JOIN follow USING (id) WHERE nxt = head),
placed AS (SELECT e.*, head, seq FROM walk JOIN heads USING (head) JOIN e USING (id)),
areas AS (SELECT parent, head, sum((x0+75)*(y1-4) - (x1+75)*(y0-4)) AS a FROM placed GROUP BY ALL),
named AS (
  SELECT head, row_number() OVER (PARTITION BY parent ORDER BY head) AS ring, sign(a) * sign(sum(a) OVER (PARTITION BY parent)) < 0 AS hole FROM areas),
t AS (SELECT parent, CAST(ring AS INT) AS ring, seq, x0 AS lon, y0 AS lat, hole FROM placed JOIN named USING (head))
SELECT parent, ring, seq, hole, {r('lon', 'lat')} FROM t"""
ORACLES["saved_rings"] = ORACLES["dissolved_centroids"]
ORACLES["touching_outline"] = """WITH corners(seq, dx, top) AS (VALUES (0, 0.0, 0), (1, 1.0, 0), (2, 1.0, 1), (3, 0.0, 1), (4, 0.0, 0)),
parts(odd, part, lo, hi) AS (VALUES (0, 0, 0.0, 1.0), (1, 0, 0.0, 0.5), (1, 1, 0.5, 1.0)),
vertices AS (
  SELECT c_custkey * 2 + part AS unit, c_mktsegment AS parent, seq, -75.0::DOUBLE + (c_custkey % 200 + dx::DOUBLE) / 61 AS lon,
         4.0::DOUBLE + (c_custkey // 200 + (CASE top WHEN 0 THEN lo ELSE hi END)::DOUBLE) / 61 AS lat
  FROM customer JOIN parts ON odd = c_custkey % 200 % 2 CROSS JOIN corners),
ends AS (SELECT unit, parent, seq, lon AS x0, lat AS y0, lead(lon) OVER w AS x1, lead(lat) OVER w AS y1 FROM vertices WINDOW w AS (PARTITION BY unit ORDER BY seq)),
whole AS (SELECT * FROM ends WHERE x1 IS NOT NULL),
points AS (SELECT DISTINCT parent, lon, lat FROM vertices),
cuts AS (
  SELECT unit, e.parent, seq, lon AS x, lat AS y, abs(lon - x0) + abs(lat - y0) AS far
  FROM whole e JOIN points p ON e.parent = p.parent AND lon BETWEEN least(x0, x1) AND greatest(x0, x1) AND lat BETWEEN least(y0, y1) AND greatest(y0, y1)),
pieces AS (SELECT parent, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM cuts WINDOW w AS (PARTITION BY unit, seq ORDER BY far)),
keyed AS (SELECT *, CASE WHEN (x0, y0) < (x1, y1) THEN (x0, y0, x1, y1) ELSE (x1, y1, x0, y0) END AS k FROM pieces WHERE x1 IS NOT NULL),
outline AS (SELECT parent, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1 FROM keyed GROUP BY parent, k HAVING count(*) = 1)
SELECT parent, """ + r('x0', 'y0', 'x1', 'y1') + " FROM outline"
_supplier_map = f"""WITH {SHIP}, cells AS (SELECT l_suppkey, year, month, sum(l_quantity) AS rfh FROM ship_rows GROUP BY ALL),
p AS (SELECT l_suppkey AS unit, month, avg(rfh) AS mean_rfh FROM cells WHERE year >= 1999 AND year < 2001 GROUP BY ALL),
t AS (SELECT coalesce(p.unit, p_partkey) AS unit, month, mean_rfh, p_name FROM p FULL JOIN part ON p.unit = p_partkey)
SELECT unit, month, p_name, {r('mean_rfh')} FROM t"""
ORACLES["profile_on_map"] = _supplier_map
ORACLES["profile_with_months"] = f"{_supplier_map} WHERE month IS NOT NULL"
ORACLES["preferred_names"] = """SELECT c_custkey, coalesce(latest, c_name) AS shown FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max(o_orderpriority, {'a': o_orderdate, 'b': o_orderkey}) AS latest FROM orders GROUP BY ALL) ON c_custkey = o_custkey"""
ORACLES["sorted_figure_rows"] = f"""WITH {ORD}, z AS (SELECT year, month, {z('incidents', 'year')} AS s FROM ord),
d AS (SELECT year, month, s - avg(s) OVER (PARTITION BY month) AS incident_deviation FROM z),
t AS (SELECT *, lag(incident_deviation) OVER (ORDER BY year, month) AS before FROM d)
SELECT year, month, {r('incident_deviation', 'before')} FROM t"""

DEVIATION_COLUMNS = ["rainfall_deviation", "incident_deviation", "temperature_deviation", *SCALED]
ORACLES["national_panel"] = f"WITH {national('month')} SELECT year, month, {r(*DEVIATION_COLUMNS)} FROM panel"
_city = """
events AS (
  SELECT year, month, count(*) AS n FROM ship_rows JOIN part ON l_partkey = p_partkey
  WHERE regexp_matches(p_name, 'widget|bolt|anvil') AND NOT regexp_matches(p_name, 'red|small') GROUP BY ALL),
months AS (SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM range(1996, 2001) a(y) CROSS JOIN range(1, 13) b(m)),
counted AS (SELECT year, month, coalesce(n, 0) AS incidents FROM events FULL JOIN months USING (year, month)),"""
ORACLES["city_panel"] = f"""WITH {national('', 'counted', _city)}
SELECT year, month, {r(*DEVIATION_COLUMNS)} FROM panel"""
ORACLES["unit_panel"] = f"""WITH {UNIT}
SELECT nation, year, month, date, time, rfh,
       {r('mean_rfh', 'standardized_incidents', 'mean_standardized_incidents', 'temperature', 'mean_temperature', *DEVIATION_COLUMNS)} FROM panel"""
ORACLES["region_panel"] = f"""WITH {SHIP}, {ORD},
region_ship AS (
  SELECT n_regionkey AS region, year, month, sum(rfh) AS rfh FROM ship_nation s JOIN nation ON s.nation = n_nationkey GROUP BY ALL),
region_ord AS (
  SELECT n_regionkey AS region, year, month, sum(incidents) AS incidents
  FROM ord_nation s JOIN nation ON s.nation = n_nationkey GROUP BY ALL),
{unit_anomalies('region', 'region_ship', 'region_ord')}
SELECT region, year, month, rfh, {r('mean_rfh', 'rainfall_deviation', 'standardized_incidents', 'mean_standardized_incidents', 'incident_deviation')}
FROM rain_dev JOIN inc_dev USING (region, year, month)"""
ORACLES["unit_recent_profile"] = f"""WITH {UNIT}, t AS (
  SELECT nation, month, avg(rainfall_deviation) AS mean_rainfall_deviation, avg(rfh) AS mean_rainfall, avg(mean_rfh) AS monthly_mean_rainfall_all,
         avg(incident_deviation) AS mean_incident_deviation, avg(standardized_incidents) AS mean_incidents,
         avg(mean_standardized_incidents) AS monthly_mean_incidents_all
  FROM panel WHERE year >= 1999 AND year < 2001 GROUP BY nation, month)
SELECT nation, month, {r('mean_rainfall_deviation', 'mean_rainfall', 'monthly_mean_rainfall_all', 'mean_incident_deviation', 'mean_incidents',
                         'monthly_mean_incidents_all')} FROM t"""

ORACLES["csv_parts"] = """SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS orders,
       CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL"""
ORACLES["csv_texts"] = "SELECT doc_id, sha256(text) AS text_sha256 FROM documents"
ORACLES["csv_wide_series"] = ORACLES["unpivot_matching_columns"]
ORACLES["csv_legacy_text"] = ORACLES["legacy_text"]
ORACLES["csv_lookup"] = f"WITH {ORD} SELECT n_name, year, month, incidents FROM ord_nation JOIN nation ON nation = n_nationkey"
_city_files = national('', 'counted', """
events AS (
  SELECT year, month, count(*) AS n FROM ship_rows JOIN part ON l_partkey = p_partkey
  WHERE regexp_matches(p_name, 'widget|anvil|ring') AND year <> 2001 GROUP BY ALL),
months AS (SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM range(1987, 2001) a(y) CROSS JOIN range(1, 13) b(m)),
counted AS (SELECT year, month, coalesce(n, 0) AS incidents FROM events FULL JOIN months USING (year, month)),""").replace(
    "AS rainfall_deviation FROM ship)", "AS rainfall_deviation FROM ship WHERE year <> 2001)")
_shown = "term, estimate, std_error, t_value, p_value, df_resid, n_obs, lower, upper"
ORACLES["city_models"] = f"""SELECT 'fe' AS model, {_shown} FROM ({coefficient_query(_city_files, ('year',))})
UNION ALL SELECT 'fe_check', {_shown} FROM ({coefficient_query(_city_files, ('year', 'month'))})"""
ORACLES["csv_bad_cells"] = """
SELECT 'o_orderkey' AS column, count(*) AS cells, 0::BIGINT AS bad, NULL::VARCHAR AS example FROM orders
UNION ALL SELECT 'day', count(*) FILTER (WHERE o_orderpriority <> '2-HIGH'), count(*) FILTER (WHERE o_orderpriority = '5-LOW'), '?5-LOW' FROM orders
UNION ALL SELECT 'price', count(*), count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), '1-URGENT' FROM orders"""
ORACLES["saved_coefficients"] = f"SELECT * FROM ({ORACLES['fe_within_national']}) WHERE term LIKE '%rainfall%'"
ORACLES["saved_polygons"] = ORACLES["dissolved_edges"]
ORACLES["saved_figure_rows"] = ORACLES["standardised_month_deviation"]
ORACLES["merged_null_keys"] = f"""WITH {SHIP}, {ORD}
SELECT nullif(s.nation, 3) AS nation, year, month, rfh, incidents FROM ship_nation s JOIN ord_nation USING (nation, year, month)"""
