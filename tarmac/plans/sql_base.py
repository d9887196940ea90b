"""DuckDB SQL building blocks for the oracle side of every check.

The oracle rebuilds the ``bookings`` table from the driver tables in plain SQL
(FIXTURES.md section 2) and derives the feature columns with the same rules as the
Spark operators, so each Spark query can be compared against an independent plan.
"""

from __future__ import annotations

from ..schema import (CANCELLED_STATUSES, LEAD_TIME_BANDS_APP, LEAD_TIME_BANDS_NOTEBOOK,
                      BOOKING_WINDOW_BANDS, LOYALTY_BANDS)
from ..sources.bookings import COMPLAINT_MODULUS, COMPLAINT_PHRASES


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _phrases_values() -> str:
    return ", ".join(f"({k}, {_sql_str(t)})" for k, t in enumerate(COMPLAINT_PHRASES))


BOOKINGS = f"""
ord AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1
              AS BIGINT) AS prior_bookings
  FROM orders
),
phrases AS (SELECT * FROM (VALUES {_phrases_values()}) AS t(phrase_k, phrase)),
bk_raw AS (
  SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS booking_id,
    CAST(o_orderdate AS DATE) AS booking_date,
    CAST(l_shipdate AS DATE) AS departure_date,
    CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 366 AS BIGINT)
      AS lead_time_days,
    p_brand AS airline,
    sn.n_name AS origin,
    cn.n_name AS destination,
    CASE WHEN cn.n_regionkey = sn.n_regionkey THEN 'Medium-Haul' ELSE 'Long-Haul' END AS haul_type,
    CASE WHEN p_type = 'PROMO' THEN 'First' WHEN p_type = 'LARGE' THEN 'Business'
         WHEN p_type = 'MEDIUM' THEN 'Premium Economy' ELSE 'Economy' END AS cabin_class,
    CASE WHEN o_orderstatus = 'O' THEN 'One-Way' WHEN o_orderstatus = 'F' THEN 'Round-Trip'
         ELSE 'Multi-City' END AS trip_type,
    nullif(o_orderpriority, '4-NOT SPECIFIED') AS fare_basis,
    c_mktsegment AS booking_channel,
    CASE WHEN l_linenumber % 2 = 1 THEN 'NDC' ELSE 'GDS' END AS booking_source,
    CAST(1 + l_quantity % 9 AS BIGINT) AS pax_count,
    l_extendedprice / (1 + l_tax) / CAST(1 + l_quantity % 9 AS BIGINT) AS base_fare_inr,
    (l_extendedprice - l_extendedprice / (1 + l_tax)) / CAST(1 + l_quantity % 9 AS BIGINT) AS taxes_inr,
    l_extendedprice AS total_fare_inr,
    CASE WHEN l_discount <> 0 THEN l_extendedprice * l_discount END AS ancillary_revenue_inr,
    CASE WHEN s_acctbal >= 0 THEN
      CASE p_size % 3 WHEN 0 THEN 'Card' WHEN 1 THEN 'Wallet' ELSE 'Bank' END END AS payment_method,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Cancelled'
         WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Refunded'
         WHEN l_returnflag = 'A' THEN 'Ticketed'
         WHEN l_returnflag = 'N' THEN 'Confirmed' END AS booking_status,
    prior_bookings,
    CASE WHEN CAST(l_quantity AS BIGINT) % 8 <> 0
         THEN CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) END AS satisfaction_score,
    (l_partkey * 31 + l_suppkey * 17 + l_orderkey) % {COMPLAINT_MODULUS} AS phrase_k
  FROM lineitem
  JOIN ord ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
),
bookings AS (
  SELECT booking_id, booking_date, departure_date, lead_time_days, airline, origin, destination,
         haul_type, cabin_class, trip_type, fare_basis, booking_channel, booking_source, pax_count,
         base_fare_inr, taxes_inr, total_fare_inr, ancillary_revenue_inr, payment_method,
         booking_status, prior_bookings, satisfaction_score, phrase AS customer_complaint
  FROM bk_raw LEFT JOIN phrases USING (phrase_k)
)"""


def band_sql(col: str, bands) -> str:
    edges, labels = bands
    parts = [f"WHEN {col} > {lo} AND {col} <= {hi} THEN {_sql_str(lab)}"
             for lo, hi, lab in zip(edges[:-1], edges[1:], labels)]
    return "CASE " + " ".join(parts) + " END"


_CANCEL = "CAST(coalesce(booking_status IN (" + ", ".join(_sql_str(s) for s in CANCELLED_STATUSES) + "), false) AS INTEGER)"

# Dashboard feature table (cleaning of the dashboard + derived columns).
FEATURES_APP = f"""
app_clean AS (
  SELECT * REPLACE (coalesce(fare_basis, 'Unknown') AS fare_basis,
                    coalesce(ancillary_revenue_inr, 0.0) AS ancillary_revenue_inr,
                    coalesce(payment_method, 'Unknown') AS payment_method,
                    coalesce(customer_complaint, '') AS customer_complaint)
  FROM bookings
),
app_route AS (
  SELECT *, origin || ' → ' || destination AS route FROM app_clean
),
route_avg AS (
  SELECT route, avg(total_fare_inr) AS route_avg_fare FROM app_route WHERE route IS NOT NULL GROUP BY route
),
fa AS (
  SELECT r.*, route_avg.route_avg_fare,
    {_CANCEL} AS is_cancelled,
    CAST(month(booking_date) AS INTEGER) AS booking_month,
    strftime(booking_date, '%b') AS booking_month_name,
    CAST(isodow(booking_date) - 1 AS INTEGER) AS booking_dayofweek,
    CASE WHEN pax_count <> 0 THEN total_fare_inr / pax_count END AS fare_per_passenger,
    CAST(prior_bookings > 0 AS INTEGER) AS is_repeat_customer,
    CAST(ancillary_revenue_inr > 0 AS INTEGER) AS has_ancillary,
    CASE WHEN route_avg_fare <> 0 THEN total_fare_inr / route_avg_fare END AS fare_to_avg_route_fare,
    CASE WHEN total_fare_inr <> 0 THEN taxes_inr / total_fare_inr END AS tax_ratio,
    CASE WHEN prior_bookings > 0 THEN 'Repeat' ELSE 'New' END AS customer_type,
    {band_sql('lead_time_days', LEAD_TIME_BANDS_APP)} AS lead_time_bin
  FROM app_route r LEFT JOIN route_avg USING (route)
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def on_bookings(body: str) -> str:
    return with_ctes(BOOKINGS, body=body)


def on_features(body: str) -> str:
    return with_ctes(BOOKINGS, FEATURES_APP, body=body)


__all__ = ["BOOKINGS", "FEATURES_APP", "band_sql", "on_bookings", "on_features", "with_ctes",
           "BOOKING_WINDOW_BANDS", "LOYALTY_BANDS", "LEAD_TIME_BANDS_NOTEBOOK"]


# ----------------------------------------------------------------------------- more CTEs
def values_dim(key: str, values, ord_name: str = "ord") -> str:
    rows = ", ".join(f"({_sql_str(v)}, {i})" for i, v in enumerate(values))
    return f"(SELECT * FROM (VALUES {rows}) AS t({key}, {ord_name}))"


def classify_sql(text: str, rule_set, other: str = "Other") -> str:
    parts = []
    for cat, pats in rule_set:
        rx = "|".join(f"(?:{p})" for p in pats)
        parts.append(f"WHEN regexp_matches({text}, {_sql_str(rx)}) THEN {_sql_str(cat)}")
    return "CASE " + " ".join(parts) + f" ELSE {_sql_str(other)} END"


def keywords_sql(text: str, rule_set) -> str:
    hits = ", ".join(f"regexp_extract({text}, {_sql_str(p)})" for _, pats in rule_set for p in pats)
    return f"array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x <> ''))), ', ')"


def lookup_sql(col: str, mapping: dict, default: str) -> str:
    parts = " ".join(f"WHEN {_sql_str(k)} THEN {_sql_str(v)}" for k, v in mapping.items())
    return f"coalesce(CASE {col} {parts} END, {_sql_str(default)})"


CLEAN_NOTEBOOK = """
nb_stats AS (
  SELECT (SELECT fare_basis FROM bookings WHERE fare_basis IS NOT NULL
          GROUP BY fare_basis ORDER BY count(*) DESC, fare_basis LIMIT 1) AS fb_mode,
         (SELECT median(satisfaction_score) FROM bookings) AS sat_median
),
nb_clean AS (
  SELECT b.* REPLACE (coalesce(b.fare_basis, s.fb_mode) AS fare_basis,
                      coalesce(b.ancillary_revenue_inr, 0.0) AS ancillary_revenue_inr,
                      coalesce(b.payment_method, 'Unknown') AS payment_method,
                      coalesce(b.satisfaction_score, s.sat_median) AS satisfaction_score,
                      coalesce(b.customer_complaint, 'No') AS customer_complaint)
  FROM bookings b CROSS JOIN nb_stats s
)"""
