"""DuckDB SQL for every SQL-expressible named query (the correctness oracle).

Written independently of the Spark operators, from the same rules: it rebuilds
``bookings`` from the driver tables, derives the features, and aggregates.  Column
names, types and the final rounding mirror ``catalog.py``.
"""

from __future__ import annotations

from ..functions.text import rules
from ..schema import (BOOKING_COLUMNS, CABIN_ORDER, CORRELATION_COLUMNS, DEFAULT_ROUTING,
                      DEFAULT_SEVERITY, FARE_QUINTILE_LABELS, LEAD_TIME_BANDS_APP,
                      LEAD_TIME_BANDS_NOTEBOOK, BOOKING_WINDOW_BANDS, LOYALTY_BANDS,
                      MONTHS_SHORT, NUMERIC_COLUMNS, OTHER_CATEGORY, PROFILED_CATEGORICALS,
                      ROUTING, SEVERITY, TARGET_CORRELATION_COLUMNS)
from .sql_base import (BOOKINGS, CLEAN_NOTEBOOK, FEATURES_APP, _sql_str, band_sql, classify_sql,
                       keywords_sql, lookup_sql, on_bookings, on_features, values_dim, with_ctes)

SQL: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    SQL[name] = text


D = "CAST({} AS DOUBLE)".format

# ----------------------------------------------------------------------------- A: business
sql("kpi_overview", on_features("""
SELECT count(*) AS total_bookings,
       round(sum(total_fare_inr), 2) AS total_revenue,
       round(sum(total_fare_inr) / 1e7, 6) AS total_revenue_cr,
       round(avg(CAST(is_cancelled AS DOUBLE)), 9) AS cancel_rate,
       CAST(sum(is_cancelled) AS BIGINT) AS cancelled,
       round(avg(satisfaction_score), 9) AS avg_satisfaction,
       count(DISTINCT airline) AS n_airlines,
       count(DISTINCT route) AS n_routes
FROM fa"""))


def _rev_by(key: str) -> str:
    return on_features(f"""
SELECT {key}, round(sum(total_fare_inr), 2) AS revenue
FROM fa WHERE {key} IS NOT NULL GROUP BY {key}""")


sql("revenue_by_airline", _rev_by("airline"))
sql("revenue_by_channel", _rev_by("booking_channel"))

sql("top_routes_revenue", on_features("""
SELECT route, round(sum(total_fare_inr), 2) AS revenue
FROM fa WHERE route IS NOT NULL GROUP BY route
ORDER BY sum(total_fare_inr) DESC, route LIMIT 10"""))

sql("revenue_by_cabin", on_features(f"""
SELECT d.cabin_class, d.cabin_ord, round(coalesce(r.revenue, 0.0), 2) AS revenue
FROM {values_dim('cabin_class', CABIN_ORDER, 'cabin_ord')} d
LEFT JOIN (SELECT cabin_class, sum(total_fare_inr) AS revenue FROM fa
           WHERE cabin_class IS NOT NULL GROUP BY cabin_class) r USING (cabin_class)"""))

sql("revenue_by_source_share", on_features("""
SELECT booking_source, round(revenue, 2) AS revenue,
       round(revenue * 100.0 / sum(revenue) OVER (), 6) AS share_pct
FROM (SELECT booking_source, sum(total_fare_inr) AS revenue FROM fa
      WHERE booking_source IS NOT NULL GROUP BY booking_source)"""))

sql("avg_fare_by_cabin", on_features("""
SELECT cabin_class, round(avg(total_fare_inr), 9) AS avg_fare
FROM fa WHERE cabin_class IS NOT NULL GROUP BY cabin_class"""))

sql("fare_mean_median", on_features("""
SELECT round(avg(total_fare_inr), 9) AS mean_fare, round(median(total_fare_inr), 9) AS median_fare FROM fa"""))

sql("cancel_rate_by_dims", on_features("\nUNION ALL\n".join(f"""
SELECT '{d}' AS dimension, {d} AS value, count(*) AS bookings,
       round(avg(CAST(is_cancelled AS DOUBLE)), 9) AS cancel_rate
FROM fa WHERE {d} IS NOT NULL GROUP BY {d}""" for d in
    ["booking_channel", "cabin_class", "trip_type", "airline"])))

sql("cancel_rate_by_lead_band", on_features(f"""
SELECT a.lead_time_bin, d.bin_ord, a.bookings, a.cancel_rate_pct
FROM (SELECT lead_time_bin, count(*) AS bookings,
             round(avg(CAST(is_cancelled AS DOUBLE)) * 100, 7) AS cancel_rate_pct
      FROM fa WHERE lead_time_bin IS NOT NULL GROUP BY lead_time_bin) a
JOIN {values_dim('lead_time_bin', LEAD_TIME_BANDS_APP[1], 'bin_ord')} d USING (lead_time_bin)"""))

_QLABELS = "[" + ", ".join(_sql_str(x).replace("\n", "' || chr(10) || '") for x in FARE_QUINTILE_LABELS) + "]"
_QUINTILE = f"""
fq_edges AS (SELECT quantile_cont(total_fare_inr, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM fa),
fq AS (
  SELECT fa.*,
         CASE WHEN total_fare_inr IS NOT NULL THEN
           1 + CAST(total_fare_inr > e[2] AS INTEGER) + CAST(total_fare_inr > e[3] AS INTEGER)
             + CAST(total_fare_inr > e[4] AS INTEGER) + CAST(total_fare_inr > e[5] AS INTEGER) END
           AS fare_quintile_ord
  FROM fa CROSS JOIN fq_edges
)"""

sql("cancel_rate_by_fare_quintile", with_ctes(BOOKINGS, FEATURES_APP, _QUINTILE, body=f"""
SELECT {_QLABELS}[fare_quintile_ord] AS fare_quintile, fare_quintile_ord, count(*) AS bookings,
       round(avg(CAST(is_cancelled AS DOUBLE)) * 100, 7) AS cancel_rate_pct
FROM fq WHERE fare_quintile_ord IS NOT NULL GROUP BY fare_quintile_ord"""))


def _sat_by(key: str) -> str:
    return on_features(f"""
SELECT {key}, round(avg(satisfaction_score), 9) AS avg_satisfaction
FROM fa WHERE {key} IS NOT NULL GROUP BY {key}""")


sql("satisfaction_by_status", _sat_by("booking_status"))
sql("satisfaction_by_airline", _sat_by("airline"))

_MONTHLY = f"""
monthly AS (
  SELECT d.month_ord, d.booking_month_name, coalesce(m.bookings, 0) AS bookings,
         coalesce(m.revenue, 0.0) AS revenue
  FROM {values_dim('booking_month_name', MONTHS_SHORT, 'month_ord')} d
  LEFT JOIN (SELECT booking_month_name, count(*) AS bookings, sum(total_fare_inr) AS revenue
             FROM fa WHERE booking_month_name IS NOT NULL GROUP BY booking_month_name) m
  USING (booking_month_name)
)"""
sql("monthly_volume", with_ctes(BOOKINGS, FEATURES_APP, _MONTHLY,
                                body="SELECT month_ord, booking_month_name, bookings FROM monthly"))
sql("monthly_revenue", with_ctes(BOOKINGS, FEATURES_APP, _MONTHLY,
                                 body="SELECT month_ord, booking_month_name, round(revenue, 2) AS revenue FROM monthly"))
sql("month_kpis", with_ctes(BOOKINGS, FEATURES_APP, _MONTHLY, body="""
SELECT v.booking_month_name AS peak_volume_month, v.bookings AS peak_volume,
       r.booking_month_name AS peak_revenue_month, round(r.revenue, 2) AS peak_revenue,
       round(a.avg_monthly_bookings, 6) AS avg_monthly_bookings
FROM (SELECT * FROM monthly ORDER BY bookings DESC, month_ord LIMIT 1) v,
     (SELECT * FROM monthly ORDER BY revenue DESC, month_ord LIMIT 1) r,
     (SELECT avg(CAST(bookings AS DOUBLE)) AS avg_monthly_bookings FROM monthly) a"""))

sql("channel_mix_by_month", on_features(f"""
, counts AS (SELECT booking_month_name, booking_channel, count(*) AS n FROM fa
             WHERE booking_month_name IS NOT NULL AND booking_channel IS NOT NULL GROUP BY ALL),
seen AS (SELECT DISTINCT booking_month_name FROM counts),
ch AS (SELECT DISTINCT booking_channel FROM counts),
grid AS (
  SELECT d.month_ord, d.booking_month_name, ch.booking_channel,
         CASE WHEN s.booking_month_name IS NOT NULL THEN coalesce(c.n, 0) END AS bookings
  FROM {values_dim('booking_month_name', MONTHS_SHORT, 'month_ord')} d CROSS JOIN ch
  LEFT JOIN counts c ON c.booking_month_name = d.booking_month_name AND c.booking_channel = ch.booking_channel
  LEFT JOIN seen s ON s.booking_month_name = d.booking_month_name
)
SELECT month_ord, booking_month_name, booking_channel, bookings,
       round(CAST(bookings AS DOUBLE) * 100.0 / sum(bookings) OVER (PARTITION BY booking_month_name), 7)
         AS share_pct
FROM grid""").replace("\n)\n, counts", "\n),\ncounts"))

sql("customer_summary", on_features("""
SELECT customer_type, bookings, round(avg_fare, 9) AS avg_fare, round(cancel_rate, 9) AS cancel_rate,
       round(avg_satisfaction, 9) AS avg_satisfaction,
       CAST(round_even(round_even(cancel_rate, 2) * 100, 2) AS DOUBLE) AS cancel_rate_pct,
       round(CAST(bookings AS DOUBLE) * 100.0 / sum(bookings) OVER (), 7) AS share_pct
FROM (SELECT customer_type, count(booking_id) AS bookings, avg(total_fare_inr) AS avg_fare,
             avg(CAST(is_cancelled AS DOUBLE)) AS cancel_rate, avg(satisfaction_score) AS avg_satisfaction
      FROM fa WHERE customer_type IS NOT NULL GROUP BY customer_type)"""))

sql("channel_performance", on_features("""
SELECT booking_channel, count(booking_id) AS bookings, round(sum(total_fare_inr), 2) AS revenue,
       round(avg(total_fare_inr), 9) AS avg_fare, round(avg(CAST(is_cancelled AS DOUBLE)), 9) AS cancel_rate
FROM fa WHERE booking_channel IS NOT NULL GROUP BY booking_channel"""))

sql("top_routes_volume", on_features("""
SELECT route, count(*) AS bookings FROM fa WHERE route IS NOT NULL GROUP BY route
ORDER BY bookings DESC, route LIMIT 10"""))

sql("status_share", on_features("""
SELECT booking_status, bookings,
       round(CAST(bookings AS DOUBLE) * 100.0 / (SELECT count(*) FROM fa), 7) AS share_pct
FROM (SELECT booking_status, count(*) AS bookings FROM fa WHERE booking_status IS NOT NULL
      GROUP BY booking_status)"""))

sql("date_range_airlines", on_features("""
SELECT min(booking_date) AS first_booking_date, max(booking_date) AS last_booking_date,
       string_agg(DISTINCT airline, ', ' ORDER BY airline) AS airlines
FROM fa"""))

# ----------------------------------------------------------------------------- Q: profiling
_nn = ", ".join(f"count({c}) AS c{i}" for i, c in enumerate(BOOKING_COLUMNS))
_nn_structs = ", ".join(
    f"{{'position': {i}, 'column_name': '{c}', 'non_null': c{i}}}" for i, c in enumerate(BOOKING_COLUMNS))
sql("null_profile", on_bookings(f"""
SELECT CAST(u.position AS INTEGER) AS position, u.column_name, u.non_null,
       rows - u.non_null AS nulls,
       round(CAST(rows - u.non_null AS DOUBLE) * 100.0 / rows, 7) AS null_pct
FROM (SELECT rows, unnest([{_nn_structs}]) AS u
      FROM (SELECT count(*) AS rows, {_nn} FROM bookings))"""))

sql("duplicate_rows", on_bookings(f"""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows
FROM (SELECT count(*) AS n FROM bookings GROUP BY {', '.join(BOOKING_COLUMNS)})"""))

sql("numeric_summary", on_bookings("\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count({c}) AS count, round(avg({D(c)}), 9) AS mean,
       round(stddev_samp({D(c)}), 9) AS std, round(min({D(c)}), 9) AS min,
       round(quantile_cont({D(c)}, 0.25), 9) AS p25, round(quantile_cont({D(c)}, 0.5), 9) AS p50,
       round(quantile_cont({D(c)}, 0.75), 9) AS p75, round(max({D(c)}), 9) AS max
FROM bookings""" for c in NUMERIC_COLUMNS)))

sql("column_profile", on_bookings("""
SELECT 'airline' AS column_name, s.rows, s.non_null, s.rows - s.non_null AS nulls, s.n_distinct,
       t.value AS top_value, t.n AS top_count
FROM (SELECT count(*) AS rows, count(airline) AS non_null, count(DISTINCT airline) AS n_distinct FROM bookings) s,
     (SELECT airline AS value, count(*) AS n FROM bookings WHERE airline IS NOT NULL
      GROUP BY airline ORDER BY n DESC, value LIMIT 1) t"""))

sql("value_counts_with_null", on_bookings("SELECT payment_method, count(*) AS count FROM bookings GROUP BY ALL"))

# Columns of few values: the sketches hold them all, so their answer is exact.
sql("column_sketches", on_bookings("\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, s.rows, s.nulls, s.d AS approx_distinct, t.value AS top_value, t.n AS top_low, t.n AS top_high
FROM (SELECT count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS d FROM bookings) s,
     (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM bookings WHERE {c} IS NOT NULL GROUP BY {c}
      ORDER BY n DESC, value LIMIT 1) t""" for c in PROFILED_CATEGORICALS)))

sql("value_counts_all", on_bookings("\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count
FROM bookings WHERE {c} IS NOT NULL GROUP BY {c}""" for c in PROFILED_CATEGORICALS)))

sql("validate_lead_time", on_bookings("""
SELECT violations, rows, violations = 0 AS passes FROM (
  SELECT CAST(sum(CASE WHEN coalesce(date_diff('day', booking_date, departure_date) <> lead_time_days, true)
                       THEN 1 ELSE 0 END) AS BIGINT) AS violations, count(*) AS rows FROM bookings)"""))

sql("validate_total_fare", on_bookings("""
SELECT violations, rows, violations = 0 AS passes FROM (
  SELECT CAST(sum(CASE WHEN coalesce(round((base_fare_inr + taxes_inr) * pax_count, 2)
                                      <> round(total_fare_inr, 2), true)
                       THEN 1 ELSE 0 END) AS BIGINT) AS violations, count(*) AS rows FROM bookings)"""))

sql("fare_outliers_iqr", on_bookings("""
, b AS (SELECT quantile_cont(total_fare_inr, 0.25) AS q1, quantile_cont(total_fare_inr, 0.75) AS q3 FROM bookings),
f AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b)
SELECT round(q1, 9) AS q1, round(q3, 9) AS q3, round(iqr, 9) AS iqr, round(lower, 9) AS lower,
       round(upper, 9) AS upper,
       CAST(sum(CASE WHEN total_fare_inr < lower OR total_fare_inr > upper THEN 1 ELSE 0 END) AS BIGINT)
         AS n_outliers,
       count(*) AS rows, 'total_fare_inr' AS column_name
FROM bookings CROSS JOIN f GROUP BY q1, q3, iqr, lower, upper""").replace("\n)\n, b AS", "\n),\nb AS"))

_BOX_COLS = ["lead_time_days", "total_fare_inr", "ancillary_revenue_inr"]
_box_long = "\nUNION ALL\n".join(
    f"SELECT is_cancelled, '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM nbx" for c in _BOX_COLS)
sql("box_stats_by_cancel", with_ctes(BOOKINGS, CLEAN_NOTEBOOK, f"""
nbx AS (SELECT *, CAST(coalesce(booking_status IN ('Cancelled', 'Refunded'), false) AS INTEGER) AS is_cancelled
        FROM nb_clean),
lng AS (SELECT * FROM ({_box_long}) WHERE v IS NOT NULL),
q AS (SELECT is_cancelled, column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM lng GROUP BY ALL),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)""", body="""
SELECT l.is_cancelled, l.column_name, round(f.q1, 9) AS q1, round(f.median, 9) AS median, round(f.q3, 9) AS q3,
       round(f.lower_fence, 9) AS lower_fence, round(f.upper_fence, 9) AS upper_fence,
       round(min(CASE WHEN v >= lower_fence AND v <= upper_fence THEN v END), 9) AS whisker_low,
       round(max(CASE WHEN v >= lower_fence AND v <= upper_fence THEN v END), 9) AS whisker_high,
       CAST(sum(CASE WHEN v >= lower_fence AND v <= upper_fence THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
       count(*) AS n
FROM lng l JOIN f USING (is_cancelled, column_name)
GROUP BY l.is_cancelled, l.column_name, f.q1, f.median, f.q3, f.lower_fence, f.upper_fence"""))


def _hist(src_ctes, table: str, column: str, digits: int, by: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    return with_ctes(*src_ctes, f"""
rng AS (SELECT min(CAST({column} AS DOUBLE)) AS lo, max(CAST({column} AS DOUBLE)) AS hi FROM {table}),
hb AS (
  SELECT {keys}CAST(CASE WHEN hi - lo = 0 THEN 0
              ELSE least(floor((CAST({column} AS DOUBLE) - lo) / (hi - lo) * 30), 29) END AS INTEGER) AS bin,
         lo, hi
  FROM {table} CROSS JOIN rng WHERE {column} IS NOT NULL
)""", body=f"""
SELECT {keys}bin, round(lo + (hi - lo) * bin / 30, {digits}) AS bin_start,
       round(lo + (hi - lo) * (bin + 1) / 30, {digits}) AS bin_end, count(*) AS count
FROM hb GROUP BY {keys}bin, lo, hi""")


sql("lead_time_histogram", _hist([BOOKINGS], "bookings", "lead_time_days", 6))
sql("fare_histogram_by_cancel", _hist([BOOKINGS, FEATURES_APP], "fa", "total_fare_inr", 9, by="is_cancelled"))

_pairs = [(a, b) for i, a in enumerate(CORRELATION_COLUMNS) for b in CORRELATION_COLUMNS[i + 1:]]
_corr_aggs = ", ".join(f"corr({D(a)}, {D(b)}) AS r{i}" for i, (a, b) in enumerate(_pairs))
_corr_structs = []
for i, (a, b) in enumerate(_pairs):
    _corr_structs.append(f"{{'col_a': '{a}', 'col_b': '{b}', 'r': r{i}}}")
    _corr_structs.append(f"{{'col_a': '{b}', 'col_b': '{a}', 'r': r{i}}}")
for a in CORRELATION_COLUMNS:
    _corr_structs.append(f"{{'col_a': '{a}', 'col_b': '{a}', 'r': 1.0::DOUBLE}}")
sql("correlation_matrix", on_bookings(f"""
SELECT u.col_a, u.col_b, round(u.r, 9) AS r
FROM (SELECT unnest([{', '.join(_corr_structs)}]) AS u FROM (SELECT {_corr_aggs} FROM bookings))"""))

_tc_aggs = ", ".join(f"corr({D(c)}, CAST(is_cancelled AS DOUBLE)) AS r{i}"
                     for i, c in enumerate(TARGET_CORRELATION_COLUMNS))
_tc_structs = ", ".join(f"{{'column_name': '{c}', 'r': r{i}}}" for i, c in enumerate(TARGET_CORRELATION_COLUMNS))
sql("target_correlation", on_features(f"""
SELECT u.column_name, round(u.r, 9) AS r,
       CAST(row_number() OVER (ORDER BY abs(u.r) DESC NULLS LAST, u.column_name) AS INTEGER) AS rank
FROM (SELECT unnest([{_tc_structs}]) AS u FROM (SELECT {_tc_aggs} FROM fa))"""))

# ----------------------------------------------------------------------------- C / P
_cols = ", ".join(BOOKING_COLUMNS)
sql("clean_notebook", with_ctes(BOOKINGS, CLEAN_NOTEBOOK, body=f"SELECT {_cols} FROM nb_clean"))
sql("clean_app", on_features(f"SELECT {_cols} FROM app_clean"))
sql("csv_round_trip", on_features(f"SELECT {_cols} FROM app_clean"))
sql("parsed_dates", on_bookings("SELECT booking_id, booking_date, departure_date FROM bookings"))
sql("revenue_per_ancillary", on_bookings("""
SELECT booking_id, round(total_fare_inr / nullif(ancillary_revenue_inr, 0), 6) AS fare_per_ancillary FROM bookings"""))
sql("base_fare_outlier_rows", on_bookings("""
SELECT booking_id, base_fare_inr FROM bookings, (SELECT quantile_cont(base_fare_inr, 0.25) AS q1,
    quantile_cont(base_fare_inr, 0.75) AS q3 FROM bookings)
WHERE base_fare_inr < q1 - 1.5 * (q3 - q1) OR base_fare_inr > q3 + 1.5 * (q3 - q1)"""))
sql("fare_outlier_rows", on_bookings("""
SELECT booking_id, total_fare_inr FROM (
  SELECT booking_id, total_fare_inr, (SELECT quantile_cont(total_fare_inr, 0.25) FROM bookings) AS q1,
         (SELECT quantile_cont(total_fare_inr, 0.75) FROM bookings) AS q3 FROM bookings)
WHERE total_fare_inr < q1 - 1.5 * (q3 - q1) OR total_fare_inr > q3 + 1.5 * (q3 - q1)"""))

_R = "round({}, {})".format
sql("features_app", on_features(f"""
SELECT * EXCLUDE (route_avg_fare) REPLACE (
  {_R('base_fare_inr', 6)} AS base_fare_inr, {_R('taxes_inr', 6)} AS taxes_inr,
  {_R('ancillary_revenue_inr', 6)} AS ancillary_revenue_inr,
  {_R('fare_per_passenger', 6)} AS fare_per_passenger,
  {_R('fare_to_avg_route_fare', 9)} AS fare_to_avg_route_fare,
  {_R('tax_ratio', 9)} AS tax_ratio)
FROM fa"""))

_NB_FEATURES = f"""
nb1 AS (
  SELECT *,
    CAST(date_diff('day', booking_date, departure_date) AS INTEGER) AS calculated_lead_time,
    (base_fare_inr + taxes_inr) * pax_count AS expected_total_fare,
    origin || '-' || destination AS route,
    CAST(month(booking_date) AS INTEGER) AS booking_month,
    strftime(booking_date, '%b') AS booking_month_name,
    strftime(booking_date, '%A') AS booking_day,
    strftime(departure_date, '%B') AS travel_month,
    CASE WHEN pax_count <> 0 THEN total_fare_inr / pax_count END AS fare_per_passenger,
    {band_sql('lead_time_days', BOOKING_WINDOW_BANDS)} AS booking_window,
    {band_sql('prior_bookings', LOYALTY_BANDS)} AS loyalty_segment,
    CAST(coalesce(booking_status IN ('Cancelled', 'Refunded'), false) AS INTEGER) AS is_cancelled,
    {band_sql('lead_time_days', LEAD_TIME_BANDS_NOTEBOOK)} AS lead_time_bin
  FROM nb_clean
),
nb_edges AS (SELECT quantile_cont(total_fare_inr, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM nb1),
nb_route AS (SELECT route, avg(total_fare_inr) AS route_avg FROM nb1 WHERE route IS NOT NULL GROUP BY route),
fn AS (
  SELECT nb1.*,
    CASE WHEN total_fare_inr IS NOT NULL THEN {_QLABELS}[
           1 + CAST(total_fare_inr > e[2] AS INTEGER) + CAST(total_fare_inr > e[3] AS INTEGER)
             + CAST(total_fare_inr > e[4] AS INTEGER) + CAST(total_fare_inr > e[5] AS INTEGER)] END
      AS fare_quintile,
    CAST(prior_bookings > 0 AS INTEGER) AS is_repeat_customer,
    CASE WHEN route_avg <> 0 THEN total_fare_inr / route_avg END AS fare_to_avg_route_fare,
    CAST(coalesce(customer_complaint <> 'No', false) AS INTEGER) AS has_complaint,
    CAST(isodow(booking_date) >= 6 AS INTEGER) AS is_weekend_booking,
    CAST(isodow(departure_date) >= 6 AS INTEGER) AS is_weekend_travel,
    CASE WHEN total_fare_inr <> 0 THEN ancillary_revenue_inr / total_fare_inr END AS ancillary_ratio,
    CASE WHEN prior_bookings > 0 THEN 'Repeat' ELSE 'New' END AS customer_type
  FROM nb1 CROSS JOIN nb_edges LEFT JOIN nb_route USING (route)
)"""

sql("features_notebook", with_ctes(BOOKINGS, CLEAN_NOTEBOOK, _NB_FEATURES, body=f"""
SELECT * REPLACE (
  {_R('base_fare_inr', 6)} AS base_fare_inr, {_R('taxes_inr', 6)} AS taxes_inr,
  {_R('ancillary_revenue_inr', 6)} AS ancillary_revenue_inr,
  {_R('fare_per_passenger', 6)} AS fare_per_passenger,
  {_R('fare_to_avg_route_fare', 9)} AS fare_to_avg_route_fare,
  {_R('ancillary_ratio', 9)} AS ancillary_ratio,
  {_R('expected_total_fare', 6)} AS expected_total_fare)
FROM fn"""))

sql("fare_vs_route_avg", on_features("""
SELECT booking_id, route, total_fare_inr, round(route_avg_fare, 9) AS route_avg_fare,
       round(CASE WHEN route_avg_fare <> 0 THEN total_fare_inr / route_avg_fare END, 9) AS fare_to_avg_route_fare
FROM fa"""))

sql("what_if_rows", on_features("""
, m AS (SELECT avg(total_fare_inr) AS mean_fare FROM fa),
c AS (SELECT booking_id, airline, cabin_class, trip_type, haul_type, booking_channel, booking_source,
             lead_time_days, pax_count, prior_bookings, base_fare_inr, taxes_inr, booking_month,
             (base_fare_inr + taxes_inr) * pax_count AS total_fare_inr FROM fa)
SELECT booking_id, airline, cabin_class, trip_type, haul_type, booking_channel, booking_source,
       lead_time_days, pax_count, prior_bookings, round(base_fare_inr, 6) AS base_fare_inr,
       round(taxes_inr, 6) AS taxes_inr, booking_month, round(total_fare_inr, 9) AS total_fare_inr,
       round(CASE WHEN pax_count <> 0 THEN total_fare_inr / pax_count ELSE total_fare_inr END, 6)
         AS fare_per_passenger,
       1 AS booking_dayofweek,
       CAST(prior_bookings > 0 AS INTEGER) AS is_repeat_customer,
       0 AS has_ancillary,
       round(CASE WHEN coalesce(mean_fare, 0) <> 0 THEN total_fare_inr / mean_fare ELSE 1.0 END, 9)
         AS fare_to_avg_route_fare,
       round(CASE WHEN total_fare_inr <> 0 THEN taxes_inr / total_fare_inr ELSE 0.0 END, 9) AS tax_ratio
FROM c CROSS JOIN m""").replace("\n)\n, m AS", "\n),\nm AS"))

# ----------------------------------------------------------------------------- T: complaints
_DASH = rules("dashboard")
_NOTE = rules("notebook")
_TAGGED = f"""
tagged AS (
  SELECT *, {classify_sql('lower(customer_complaint)', _DASH)} AS category
  FROM fa WHERE length(customer_complaint) > 0
)"""


def on_tagged(body: str) -> str:
    return with_ctes(BOOKINGS, FEATURES_APP, _TAGGED, body=body)


sql("classify_dashboard", on_tagged(f"""
SELECT booking_id, customer_complaint, category,
       {lookup_sql('category', SEVERITY, DEFAULT_SEVERITY)} AS severity,
       {lookup_sql('category', {k: v[0] for k, v in ROUTING.items()}, DEFAULT_ROUTING[0])} AS routing_team,
       {lookup_sql('category', {k: v[1] for k, v in ROUTING.items()}, DEFAULT_ROUTING[1])} AS routing_action,
       {keywords_sql('lower(customer_complaint)', _DASH)} AS matched_keywords
FROM tagged"""))

sql("classify_notebook", on_bookings(f"""
SELECT booking_id, customer_complaint,
       CASE WHEN trim(lower(customer_complaint)) IN ('', 'nan', 'no') THEN 'No Complaint'
            ELSE {classify_sql('trim(lower(customer_complaint))', _NOTE)} END AS complaint_category
FROM bookings
WHERE customer_complaint IS NOT NULL AND customer_complaint <> '' AND customer_complaint <> 'No'"""))

_cats = [c for c, _ in _DASH] + [OTHER_CATEGORY]
_rule_rows = ", ".join(
    f"({i}, {_sql_str(c)}, {_sql_str(SEVERITY.get(c, 'Low'))}, {_sql_str(ROUTING.get(c, ('—', '—'))[0])})"
    for i, c in enumerate(_cats))
sql("rule_table", on_tagged(f"""
SELECT r.category, CAST(r.priority AS INTEGER) AS priority, r.severity, r.routing_team,
       coalesce(n.complaints, 0) AS complaints
FROM (SELECT * FROM (VALUES {_rule_rows}) AS t(priority, category, severity, routing_team)) r
LEFT JOIN (SELECT category, count(*) AS complaints FROM tagged GROUP BY category) n USING (category)"""))

sql("complaints_by_dim", on_tagged("\nUNION ALL\n".join(f"""
SELECT '{d}' AS dimension, {d} AS value, count(*) AS complaints FROM tagged
WHERE {d} IS NOT NULL GROUP BY {d}""" for d in ["category", "airline", "booking_channel"])))


def _crosstab(column: str) -> str:
    return on_tagged(f"""
, ct AS (SELECT category, {column}, count(*) AS n FROM tagged WHERE {column} IS NOT NULL GROUP BY ALL),
g AS (SELECT c.category, v.{column} FROM (SELECT DISTINCT category FROM ct) c
      CROSS JOIN (SELECT DISTINCT {column} FROM ct) v)
SELECT g.category, g.{column}, coalesce(ct.n, 0) AS complaints,
       round(CAST(coalesce(ct.n, 0) AS DOUBLE) * 100.0
             / sum(coalesce(ct.n, 0)) OVER (PARTITION BY g.{column}), 7) AS col_pct
FROM g LEFT JOIN ct USING (category, {column})""").replace("\n)\n, ct AS", "\n),\nct AS")


sql("complaint_crosstab_status", _crosstab("booking_status"))
sql("complaint_crosstab_airline", _crosstab("airline"))

_piv = ", ".join(f"count(*) FILTER (WHERE category = {_sql_str(c)}) AS \"{c}\"" for c in _cats)
sql("airline_category_pivot", on_tagged(f"""
SELECT airline, {_piv} FROM tagged WHERE airline IS NOT NULL GROUP BY airline"""))


def _top(key: str, alias: str) -> str:
    return (f"(SELECT {key} AS {alias}, count(*) AS n FROM tagged WHERE {key} IS NOT NULL "
            f"GROUP BY {key} ORDER BY n DESC, {key} LIMIT 1)")


sql("complaint_kpis", on_tagged(f"""
SELECT t.total_complaints, t.n_categories, c.top_category, c.n AS top_category_complaints,
       a.top_airline, h.top_channel,
       round(CAST(t.total_complaints AS DOUBLE) * 100.0 / (SELECT count(*) FROM fa), 7) AS complaint_share_pct
FROM (SELECT count(*) AS total_complaints, count(DISTINCT category) AS n_categories FROM tagged) t,
     {_top('category', 'top_category')} c, {_top('airline', 'top_airline')} a,
     {_top('booking_channel', 'top_channel')} h"""))

sql("complaint_listing", on_tagged("""
SELECT booking_id, airline, booking_channel, booking_status, total_fare_inr, customer_complaint, category
FROM tagged"""))

_line = " || ' | ' || ".join([f"{_sql_str(c + '=')} || CAST(\"{c}\" AS VARCHAR)" for c in _cats])
sql("summary_input", on_tagged(f"""
, piv AS (SELECT airline, {_piv} FROM tagged WHERE airline IS NOT NULL GROUP BY airline),
cc AS (SELECT category, count(*) AS n FROM tagged GROUP BY category),
smp AS (SELECT md5('42:' || booking_id) AS k, customer_complaint FROM tagged ORDER BY k LIMIT 30)
SELECT (SELECT count(*) FROM tagged) AS n_complaints,
       (SELECT string_agg(category || ': ' || CAST(n AS VARCHAR), chr(10) ORDER BY n DESC, category) FROM cc)
         AS category_distribution,
       (SELECT string_agg(airline || ' | ' || {_line}, chr(10) ORDER BY airline) FROM piv) AS airline_table,
       (SELECT string_agg('- ' || customer_complaint, chr(10) ORDER BY k, customer_complaint) FROM smp)
         AS sample_complaints,
       (SELECT count(*) FROM smp) AS n_sampled""").replace("\n)\n, piv AS", "\n),\npiv AS"))


def oracle_sql() -> dict[str, str]:
    from . import oracle_more  # noqa: F401  (registers the remaining groups)
    return dict(SQL)
