"""Oracle SQL for retrieval, report and model-evaluation queries."""

from __future__ import annotations

from ..functions.text import rules
from ..operators.embedding import DIM, FEATURES
from .oracle import sql
from .sql_base import (BOOKINGS, CLEAN_NOTEBOOK, FEATURES_APP, _sql_str, on_features, with_ctes)

_BOOKING_DOC_COLS = """
  'booking_' || booking_id AS doc_id, 'booking' AS doc_type,
  'Booking ' || booking_id || ': ' || airline || ' flight from ' || origin || ' to ' || destination
    || ' (' || haul_type || ', ' || cabin_class || ', ' || trip_type || '). Booked on '
    || strftime(booking_date, '%Y-%m-%d') || ' 00:00:00 via ' || booking_channel || ' (' || booking_source || '). '
    || 'Lead time: ' || CAST(lead_time_days AS VARCHAR) || ' days. '
    || 'Passengers: ' || CAST(pax_count AS VARCHAR) || '. '
    || 'Total fare: ₹' || format('{:,.0f}', total_fare_inr) || '. '
    || 'Status: ' || booking_status || '. '
    || 'Customer type: ' || CASE WHEN prior_bookings > 0 THEN 'Repeat' ELSE 'New' END
    || ' (prior bookings: ' || CAST(prior_bookings AS VARCHAR) || '). '
    || 'Satisfaction score: ' || coalesce(CAST(satisfaction_score AS VARCHAR), 'N/A') || '.' AS text"""

_BOOKING_META = """
  CAST(json_object('type', 'booking', 'booking_id', booking_id, 'airline', airline, 'origin', origin,
                   'destination', destination, 'booking_status', booking_status,
                   'cabin_class', cabin_class, 'booking_channel', booking_channel,
                   'total_fare_inr', CAST(round(total_fare_inr, 2) AS VARCHAR)) AS VARCHAR) AS metadata_json"""

_STRIP = "regexp_replace(customer_complaint, '^\\s+|\\s+$', '', 'g')"
_HAS = ("customer_complaint IS NOT NULL AND "
        "trim(lower(customer_complaint)) NOT IN ('nan', 'none', '')")
_COMPLAINT_DOC_COLS = f"""
  'complaint_' || booking_id AS doc_id, 'complaint' AS doc_type,
  'Complaint from booking ' || booking_id || ' (' || airline || ', ' || booking_channel
    || ', status: ' || booking_status || '): ' || {_STRIP} AS text"""
_COMPLAINT_META = f"""
  CAST(json_object('type', 'complaint', 'booking_id', booking_id, 'airline', airline,
                   'booking_channel', booking_channel, 'booking_status', booking_status,
                   'complaint_text', substring({_STRIP}, 1, 200)) AS VARCHAR) AS metadata_json"""

sql("booking_documents", on_features(f"SELECT {_BOOKING_DOC_COLS}, {_BOOKING_META} FROM fa"))
sql("complaint_documents", on_features(
    f"SELECT {_COMPLAINT_DOC_COLS}, {_COMPLAINT_META} FROM fa WHERE {_HAS}"))

_INDEX = f"""
idx AS (
  SELECT {_BOOKING_DOC_COLS} FROM fa
  UNION ALL
  SELECT {_COMPLAINT_DOC_COLS} FROM fa WHERE {_HAS}
),
batch AS (
  SELECT {_BOOKING_DOC_COLS} FROM nb_clean
  WHERE booking_id IN (SELECT booking_id FROM bookings WHERE satisfaction_score IS NULL)
),
upserted AS (
  SELECT * FROM idx WHERE doc_id NOT IN (SELECT doc_id FROM batch)
  UNION ALL SELECT * FROM batch
)"""

sql("upsert_documents", with_ctes(BOOKINGS, FEATURES_APP, CLEAN_NOTEBOOK, _INDEX,
                                  body="SELECT doc_id, doc_type, text FROM upserted"))
sql("index_completeness", with_ctes(BOOKINGS, FEATURES_APP, CLEAN_NOTEBOOK, _INDEX, body=f"""
SELECT e.bookings, e.complaint_docs, g.indexed, e.bookings + e.complaint_docs AS expected,
       g.indexed >= e.bookings + e.complaint_docs AS complete
FROM (SELECT count(*) AS bookings,
             CAST(sum(CASE WHEN {_HAS} THEN 1 ELSE 0 END) AS BIGINT) AS complaint_docs FROM fa) e,
     (SELECT count(*) AS indexed FROM upserted) g"""))

_DOT = ("list_reduce(list_transform(list_zip(e.embedding, q.query_embedding), "
        "lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)), lambda acc, x: acc + x)")
_TOPK = f"""
WITH q AS (
  SELECT f.label AS query_label, f.query_id, e.embedding AS query_embedding
  FROM (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY label) f
  JOIN embeddings e ON e.vec_id = f.query_id
),
scored AS (
  SELECT q.query_label, q.query_id, e.vec_id, e.label, {_DOT} AS score
  FROM embeddings e CROSS JOIN q
),
hits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= 8
)"""
sql("cosine_topk", _TOPK + """
SELECT query_label, query_id, rank, vec_id, label, round_even(score, 4) AS similarity FROM hits""")
sql("prompt_context", _TOPK + """
SELECT h.query_id,
       string_agg('[Record ' || CAST(h.rank AS VARCHAR) || ' | similarity='
                  || CAST(round_even(h.score, 4) AS VARCHAR) || ']' || chr(10) || coalesce(d.text, ''),
                  chr(10) || chr(10) ORDER BY h.rank) AS context,
       count(*) AS n_records
FROM hits h LEFT JOIN documents d ON d.doc_id = h.vec_id
GROUP BY h.query_id""")

_SEARCH = f"""
WITH q AS (
  SELECT label AS query_label, vec_id AS query_id, embedding AS query_embedding FROM embeddings WHERE vec_id % 20 = 0
),
scored AS (
  SELECT q.query_label, q.query_id, e.vec_id, e.label, {_DOT} AS score
  FROM embeddings e CROSS JOIN q
),
hits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= 8
)"""
sql("cosine_search", _SEARCH + """
SELECT query_label, query_id, rank, vec_id, label, round_even(score, 4) AS similarity FROM hits""")
sql("prompt_context_search", _SEARCH + """
SELECT h.query_id,
       string_agg('[Record ' || CAST(h.rank AS VARCHAR) || ' | similarity='
                  || CAST(round_even(h.score, 4) AS VARCHAR) || ']' || chr(10) || coalesce(d.text, ''),
                  chr(10) || chr(10) ORDER BY h.rank) AS context,
       count(*) AS n_records
FROM hits h LEFT JOIN documents d ON d.doc_id = h.vec_id
GROUP BY h.query_id""")

_questions = ", ".join(f"({i}, {_sql_str(c)})" for i, (c, _) in enumerate(rules("dashboard")))
def _text_sql(term: str) -> str:
    return with_ctes(BOOKINGS, FEATURES_APP, f"""
corpus AS (
  SELECT {_BOOKING_DOC_COLS} FROM fa
  UNION ALL
  SELECT {_COMPLAINT_DOC_COLS} FROM fa WHERE {_HAS}
),
tok AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM corpus),
tf AS (SELECT doc_id, {term} AS term, count(*) AS tf FROM tok WHERE word <> '' GROUP BY ALL),
m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM corpus),
idf AS (SELECT term, ln((m + 1) / (CAST(count(*) AS DOUBLE) + 1)) AS idf FROM tf, m GROUP BY term, m),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
dw AS (SELECT doc_id, term, CASE WHEN norm > 0 THEN w / norm ELSE 0.0 END AS weight FROM w JOIN nrm USING (doc_id)),
qs AS (SELECT * FROM (VALUES {_questions}) AS t(query_id, question)),
qtok AS (SELECT query_id, unnest(string_split_regex(lower(question), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM qs),
qtf AS (SELECT query_id, {term} AS term, count(*) AS tf FROM qtok WHERE word <> '' GROUP BY ALL),
qw AS (SELECT query_id, term, tf * coalesce(idf, ln(m + 1.0)) AS w FROM qtf LEFT JOIN idf USING (term), m),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY query_id),
qv AS (SELECT query_id, term, w / norm AS q_weight FROM qw JOIN qn USING (query_id)),
hit AS (SELECT query_id, doc_id, round(sum(weight * q_weight), 9) AS score
        FROM dw JOIN qv USING (term) GROUP BY query_id, doc_id),
sc AS (SELECT q.query_id, c.doc_id, coalesce(hit.score, 0.0) AS score FROM qs q CROSS JOIN corpus c
       LEFT JOIN hit ON hit.query_id = q.query_id AND hit.doc_id = c.doc_id)""", body="""
SELECT CAST(query_id AS INTEGER) AS query_id,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, score
FROM sc QUALIFY rank <= 8""")


_SUFFIX = r"'^(\p{L}{3,}?)(?:ations?|ings?|ed)$|^(\p{L}{2,}[^s\p{N}])s$'"
_STEM_TERM = (rf"CASE WHEN regexp_matches(word, {_SUFFIX}) THEN regexp_replace(regexp_replace(word, {_SUFFIX}, '\1\2'), "
              r"'(l)l$|(p)p$|(t)t$', '\1\2\3') ELSE word END")
sql("text_embed_topk", _text_sql(_STEM_TERM))
sql("text_embed_topk_stems", _text_sql(_STEM_TERM))

def _hashed(corpora: str, key: str, spaces: str) -> str:
    """CTEs ``vec``: (key, slot, v) by signed hashing.  ``corpora`` has (space, key, text) rows to count
    document frequencies on, ``spaces`` (key, space, text) rows to embed."""
    return rf"""
cw AS (SELECT space, {key}, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+')) AS word FROM {corpora}),
cf AS (SELECT DISTINCT space, {key}, ('0x' || substr(md5({_STEM_TERM}), 1, 5))::BIGINT % {FEATURES} AS feature
       FROM cw WHERE word <> ''),
cn AS (SELECT space, CAST(count(*) AS DOUBLE) AS m FROM {corpora} GROUP BY space),
ci AS (SELECT space, feature, ln((m + 1) / (CAST(count(*) AS DOUBLE) + 1)) AS idf FROM cf JOIN cn USING (space)
       GROUP BY space, feature, m),
ew AS (SELECT space, {key}, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+')) AS word FROM {spaces}),
eh AS (SELECT space, {key}, md5({_STEM_TERM}) AS h FROM ew WHERE word <> ''),
es AS (SELECT {key}, ('0x' || substr(h, 6, 4))::BIGINT % {DIM} AS slot,
         sum((1 - 2 * (('0x' || substr(h, 10, 1))::BIGINT % 2)) * idf) AS v
       FROM eh JOIN ci ON ci.space = eh.space AND feature = ('0x' || substr(h, 1, 5))::BIGINT % {FEATURES}
       GROUP BY ALL),
en AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM es GROUP BY {key}),
vec AS (SELECT {key}, slot, CAST(CAST(round(v / norm, 6) AS FLOAT) AS DOUBLE) AS v FROM es JOIN en USING ({key}) WHERE norm > 0)"""


sql("stored_documents", with_ctes(BOOKINGS, FEATURES_APP, CLEAN_NOTEBOOK, _INDEX, """
corpora AS (SELECT 1 AS space, doc_id, text FROM idx UNION ALL SELECT 2, doc_id, text FROM upserted),
spaces AS (SELECT u.doc_id, u.text, CASE WHEN b.doc_id IS NULL THEN 1 ELSE 2 END AS space
           FROM upserted u LEFT JOIN batch b USING (doc_id))""", _hashed("corpora", "doc_id", "spaces"), f"""
dig AS (SELECT doc_id, sum(v * (slot + 1)) AS d FROM vec GROUP BY doc_id)""", body=f"""
SELECT doc_id, doc_type, text, CASE WHEN doc_type = 'booking' THEN 9 ELSE 6 END AS n_metadata,
       {DIM} AS dim, round(coalesce(d, 0.0), 4) AS vector_digest
FROM upserted LEFT JOIN dig USING (doc_id)"""))
sql("conversation_search", f"""
WITH turns AS (SELECT conv_id, conv_id || '-' || turn AS doc_id, coalesce(text, '') AS text FROM conversations),
corpora AS (SELECT 1 AS space, doc_id, text FROM turns),
{_hashed("corpora", "doc_id", "corpora")},
dots AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.v * d.v) AS s FROM vec q JOIN vec d USING (slot)
         WHERE q.doc_id IN (SELECT doc_id FROM turns WHERE conv_id % 20 = 0) GROUP BY ALL),
scored AS (SELECT q.doc_id AS query_id, c.doc_id, coalesce(s, 0.0) AS score FROM turns q CROSS JOIN turns c
           LEFT JOIN dots ON dots.query_id = q.doc_id AND dots.doc_id = c.doc_id WHERE q.conv_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, round_even(score, 4) AS similarity
FROM scored QUALIFY rank <= 8""")
sql("text_search", f"""
WITH corpus AS (SELECT conv_id, conv_id || '-' || turn AS doc_id, coalesce(text, '') AS text FROM conversations),
tok AS (SELECT conv_id, doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM corpus),
tf AS (SELECT conv_id, doc_id, {_STEM_TERM} AS term, count(*) AS tf FROM tok WHERE word <> '' GROUP BY ALL),
m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM corpus),
idf AS (SELECT term, ln((m + 1) / (CAST(count(*) AS DOUBLE) + 1)) AS idf FROM tf, m GROUP BY term, m),
w AS (SELECT conv_id, doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
dw AS (SELECT conv_id, doc_id, term, CASE WHEN norm > 0 THEN w / norm ELSE 0.0 END AS weight FROM w JOIN nrm USING (doc_id)),
hit AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(d.weight * q.weight), 9) AS score
        FROM dw d JOIN dw q USING (term) WHERE q.conv_id % 20 = 0 GROUP BY ALL)
SELECT q.doc_id AS query_id,
       CAST(row_number() OVER (PARTITION BY q.doc_id ORDER BY coalesce(hit.score, 0.0) DESC, c.doc_id) AS INTEGER) AS rank,
       c.doc_id, coalesce(hit.score, 0.0) AS score
FROM corpus q CROSS JOIN corpus c LEFT JOIN hit ON hit.query_id = q.doc_id AND hit.doc_id = c.doc_id
WHERE q.conv_id % 20 = 0 QUALIFY rank <= 8""")


# ----------------------------------------------------------------------------- R6 report
def _report_sql() -> str:
    from ..operators.report import SEP, TITLE
    from ..schema import CABIN_ORDER, MONTHS_SHORT
    from .sql_base import values_dim
    from .oracle import _TAGGED

    M = "coalesce(format('{{:,.0f}}', round(CAST({} AS DOUBLE), 2)), 'nan')".format
    FX = "coalesce(format('{{:.{}f}}', CAST({} AS DOUBLE)), 'nan')".format

    def const(b, p, text):
        return f"SELECT {b} AS block, CAST({p} AS BIGINT) AS pos, {_sql_str(text)} AS line"

    def rows(b, line, src, order, start=1):
        return (f"SELECT {b} AS block, CAST(row_number() OVER (ORDER BY {order}) + {start - 1} AS BIGINT) AS pos, "
                f"{line} AS line FROM {src}")

    def dim(key):
        return (f"(SELECT {key} AS value, count(*) AS bookings, sum(total_fare_inr) AS revenue, "
                f"avg(total_fare_inr) AS avg_fare, avg(CAST(is_cancelled AS DOUBLE)) AS cancel_rate, "
                f"avg(satisfaction_score) AS avg_satisfaction FROM fa WHERE {key} IS NOT NULL GROUP BY {key})")

    def cdim(key):
        return f"(SELECT {key} AS value, count(*) AS complaints FROM tagged WHERE {key} IS NOT NULL GROUP BY {key})"

    h = "hd"
    parts = [
        const(0, 0, SEP), const(0, 1, TITLE),
        f"SELECT 0, CAST(2 AS BIGINT), 'Total bookings: ' || {M('n')} FROM {h}",
        f"SELECT 0, CAST(3 AS BIGINT), 'Date range: ' || CAST(first_date AS VARCHAR) || ' to ' || CAST(last_date AS VARCHAR) FROM {h}",
        f"SELECT 0, CAST(4 AS BIGINT), 'Airlines: ' || airlines FROM {h}",
        const(0, 5, SEP),
        const(1, 0, "\n-- REVENUE --"),
        f"SELECT 1, CAST(1 AS BIGINT), 'Total revenue: INR ' || {M('revenue')} FROM {h}",
        f"SELECT 1, CAST(2 AS BIGINT), 'Average fare per booking: INR ' || {M('mean_fare')} FROM {h}",
        f"SELECT 1, CAST(3 AS BIGINT), 'Median fare: INR ' || {M('median_fare')} FROM {h}",
        const(2, 0, "Revenue by airline:"),
        rows(2, f"'  ' || value || ': INR ' || {M('revenue')}", dim("airline"), "revenue DESC, value"),
        const(3, 0, "Revenue by cabin class:"),
        rows(3, f"'  ' || value || ': INR ' || {M('revenue')}",
             f"({values_dim('value', CABIN_ORDER)} LEFT JOIN {dim('cabin_class')} USING (value))", "ord"),
        const(4, 0, "Revenue by booking source (NDC vs GDS):"),
        rows(4, f"'  ' || value || ': INR ' || {M('revenue')}", dim("booking_source"), "value"),
        const(5, 0, "Revenue by booking channel:"),
        rows(5, f"'  ' || value || ': INR ' || {M('revenue')}", dim("booking_channel"), "revenue DESC, value"),
        const(6, 0, "Top 10 routes by revenue:"),
        rows(6, f"'  ' || value || ': INR ' || {M('revenue')}",
             f"(SELECT * FROM {dim('route')} ORDER BY revenue DESC, value LIMIT 10)", "revenue DESC, value"),
        const(7, 0, "\n-- CANCELLATIONS --"),
        f"SELECT 7, CAST(1 AS BIGINT), 'Overall cancellation/refund rate: ' || {FX(2, 'cancel_rate * 100')} || '%' FROM {h}",
        f"SELECT 7, CAST(2 AS BIGINT), 'Total cancelled/refunded: ' || {M('cancelled')} || ' of ' || {M('n')} FROM {h}",
        const(8, 0, "Booking status breakdown:"),
        rows(8, f"'  ' || value || ': ' || {M('bookings')} || ' (' || {FX(1, 'bookings / n * 100')} || '%)'",
             f"({dim('booking_status')} CROSS JOIN (SELECT n FROM {h}))", "bookings DESC, value"),
    ]
    for b, (name, title) in enumerate([("booking_channel", "Cancellation rate by booking channel:"),
                                       ("cabin_class", "Cancellation rate by cabin class:"),
                                       ("trip_type", "Cancellation rate by trip type:"),
                                       ("airline", "Cancellation rate by airline:")], start=9):
        parts += [const(b, 0, title),
                  rows(b, f"'  ' || value || ': ' || {FX(2, 'cancel_rate * 100')} || '%'", dim(name),
                       "cancel_rate DESC, value")]
    months = f"({values_dim('value', MONTHS_SHORT)} LEFT JOIN {dim('booking_month_name')} USING (value))"
    parts += [
        const(13, 0, "\n-- BOOKING TRENDS --"), const(13, 1, "Monthly booking volume:"),
        rows(13, f"'  ' || value || ': ' || {M('coalesce(bookings, 0)')}", months, "ord", start=2),
        const(14, 0, "Monthly revenue:"),
        rows(14, f"'  ' || value || ': INR ' || {M('coalesce(revenue, 0.0)')}", months, "ord"),
        const(15, 0, "\n-- ROUTE POPULARITY --"), const(15, 1, "Top 10 routes by booking volume:"),
        rows(15, f"'  ' || value || ': ' || {M('bookings')} || ' bookings'",
             f"(SELECT * FROM {dim('route')} ORDER BY bookings DESC, value LIMIT 10)", "bookings DESC, value",
             start=2),
        const(16, 0, "\n-- CUSTOMER BEHAVIOUR --"), const(16, 1, "New vs Repeat customer comparison:"),
        rows(16, f"'  ' || value || ': ' || {M('bookings')} || ' bookings | Avg fare INR ' || "
                 f"{M('round_even(avg_fare, 2)')} || ' | Cancel rate ' || {FX(1, 'round_even(cancel_rate, 2) * 100')}"
                 f" || '% | Avg satisfaction ' || {FX(2, 'round_even(avg_satisfaction, 2)')}",
             dim("customer_type"), "value", start=2),
        const(17, 0, "\n-- SATISFACTION --"),
        f"SELECT 17, CAST(1 AS BIGINT), 'Overall avg satisfaction: ' || {FX(2, 'avg_satisfaction')} || ' / 5' FROM {h}",
        const(17, 2, "Average satisfaction by airline:"),
        rows(17, f"'  ' || value || ': ' || {FX(2, 'avg_satisfaction')}", dim("airline"),
             "avg_satisfaction DESC NULLS LAST, value", start=3),
        const(18, 0, "\n-- COMPLAINTS --"),
        f"SELECT 18, CAST(1 AS BIGINT), 'Total bookings with complaints: ' || {M('n_complaints')} || ' (' || "
        f"{FX(1, 'n_complaints / n * 100')} || '%)' FROM {h}",
        const(18, 2, "Complaint categories:"),
        rows(18, f"'  ' || value || ': ' || {M('complaints')}", cdim("category"), "complaints DESC, value", start=3),
        const(19, 0, "Complaints by airline:"),
        rows(19, f"'  ' || value || ': ' || {M('complaints')}", cdim("airline"), "complaints DESC, value"),
        const(20, 0, "Complaints by channel:"),
        rows(20, f"'  ' || value || ': ' || {M('complaints')}", cdim("booking_channel"), "complaints DESC, value"),
        const(21, 0, "\n-- CHANNEL PERFORMANCE --"), const(21, 1, "Booking channel performance summary:"),
        rows(21, f"'  ' || value || ': ' || {M('bookings')} || ' bookings | Revenue INR ' || {M('revenue')} || "
                 f"' | Avg fare INR ' || {M('avg_fare')} || ' | Cancel rate ' || {FX(1, 'cancel_rate * 100')} || '%'",
             dim("booking_channel"), "value", start=2),
        const(22, 0, "\n" + SEP),
    ]
    body = "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)
    hd = """
hd AS (
  SELECT count(*) AS n, min(booking_date) AS first_date, max(booking_date) AS last_date,
         string_agg(DISTINCT airline, ', ' ORDER BY airline) AS airlines,
         sum(total_fare_inr) AS revenue, avg(total_fare_inr) AS mean_fare, median(total_fare_inr) AS median_fare,
         avg(CAST(is_cancelled AS DOUBLE)) AS cancel_rate, CAST(sum(is_cancelled) AS BIGINT) AS cancelled,
         avg(satisfaction_score) AS avg_satisfaction, (SELECT count(*) FROM tagged) AS n_complaints
  FROM fa
),
lines AS (""" + body + "\n)"
    return with_ctes(BOOKINGS, FEATURES_APP, _TAGGED, hd, body="")


_REPORT = _report_sql()
sql("metrics_facts", _REPORT + "SELECT CAST(block AS INTEGER) AS block, pos, line FROM lines")
sql("metrics_facts_stored", _REPORT + "SELECT CAST(block AS INTEGER) AS block, pos, line FROM lines")
sql("metrics_text", _REPORT + """SELECT string_agg(line, chr(10) ORDER BY block, pos) AS context,
       count(*) AS n_lines FROM lines""")


# ----------------------------------------------------------------------------- M: model checks
def _model_sql():
    from ..schema import NOTEBOOK_CATEGORICAL_FEATURES
    from .oracle import _NB_FEATURES

    sql("stratified_split", on_features("""
SELECT booking_id, is_cancelled,
       CASE WHEN rn - 1 < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split
FROM (SELECT booking_id, is_cancelled,
             row_number() OVER (PARTITION BY is_cancelled ORDER BY md5('42:' || booking_id), booking_id) AS rn,
             count(*) OVER (PARTITION BY is_cancelled) AS n
      FROM fa)"""))

    cols = NOTEBOOK_CATEGORICAL_FEATURES
    firsts = ", ".join(f"coalesce(min(CAST({c} AS VARCHAR)), 'nan') AS f_{c}" for c in cols)
    feats = ", ".join(
        f"CASE WHEN coalesce(CAST({c} AS VARCHAR), 'nan') <> f_{c} "
        f"THEN '{c}_' || coalesce(CAST({c} AS VARCHAR), 'nan') END" for c in cols)
    sql("onehot_drop_first", with_ctes(BOOKINGS, CLEAN_NOTEBOOK, _NB_FEATURES, f"""
firsts AS (SELECT {firsts} FROM fn)""", body=f"""
SELECT booking_id,
       array_to_string(list_sort(list_filter([{feats}], lambda x: x IS NOT NULL)), '|') AS active_features
FROM fn CROSS JOIN firsts"""))

    scored = """
rates_ch AS (SELECT booking_channel, avg(CAST(is_cancelled AS DOUBLE)) AS ch_rate FROM fa GROUP BY booking_channel),
rates_lb AS (SELECT lead_time_bin, avg(CAST(is_cancelled AS DOUBLE)) AS lb_rate FROM fa
             WHERE lead_time_bin IS NOT NULL GROUP BY lead_time_bin),
rates_all AS (SELECT avg(CAST(is_cancelled AS DOUBLE)) AS all_rate FROM fa),
scored AS (
  SELECT fa.*, (ch_rate + coalesce(lb_rate, all_rate)) / 2 AS score, ch_rate * 100 AS channel_cancel_pct
  FROM fa LEFT JOIN rates_ch USING (booking_channel) LEFT JOIN rates_lb USING (lead_time_bin)
  CROSS JOIN rates_all
)"""
    sql("risk_tier_reasons", with_ctes(BOOKINGS, FEATURES_APP, scored, body="""
SELECT booking_id, round(score, 9) AS score, round(score * 100, 6) AS prob_pct,
       CASE WHEN score * 100 >= 60 THEN '🔴 HIGH RISK' WHEN score * 100 >= 35 THEN '🟡 MEDIUM RISK'
            ELSE '🟢 LOW RISK' END AS risk_tier,
       CASE WHEN score * 100 >= 60 THEN '⚠️ Flag for proactive agent outreach. Consider mandatory deposit.'
            WHEN score * 100 >= 35 THEN 'ℹ️ Monitor booking. Send automated confirmation reminder.'
            ELSE '✅ Standard processing. No intervention required.' END AS risk_action,
       CASE WHEN lead_time_days > 90 THEN 'High' WHEN lead_time_days > 30 THEN 'Medium' ELSE 'Low' END
         AS lead_impact,
       CASE WHEN total_fare_inr > 100000 THEN 'High' WHEN total_fare_inr > 30000 THEN 'Medium' ELSE 'Low' END
         AS fare_impact,
       CASE WHEN prior_bookings > 3 THEN 'Low (loyal customer)' WHEN prior_bookings > 0 THEN 'Medium'
            ELSE 'High (new customer)' END AS history_impact,
       round(channel_cancel_pct, 6) AS channel_cancel_pct
FROM scored"""))

    sql("auc_roc_curve", with_ctes(BOOKINGS, FEATURES_APP, scored, """
per AS (SELECT round(score, 12) AS threshold, CAST(sum(is_cancelled) AS BIGINT) AS pos,
               CAST(sum(1 - is_cancelled) AS BIGINT) AS neg FROM scored GROUP BY round(score, 12)),
cum AS (
  SELECT threshold, pos, neg,
         sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
         sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
         coalesce(sum(neg) OVER (ORDER BY threshold ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS neg_below,
         sum(pos) OVER () AS p_all, sum(neg) OVER () AS n_all
  FROM per
)""", body="""
SELECT round(threshold, 9) AS threshold, pos, neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(CAST(tp AS DOUBLE) / p_all, 9) AS tpr, round(CAST(fp AS DOUBLE) / n_all, 9) AS fpr,
       round(sum(pos * (neg_below + neg / 2.0)) OVER () / CAST(p_all * n_all AS DOUBLE), 9) AS auc
FROM cum"""))

    sql("confusion_matrix", with_ctes(BOOKINGS, FEATURES_APP, scored, body="""
SELECT g.actual, g.predicted, coalesce(c.count, 0) AS count
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(actual, predicted)) g
LEFT JOIN (SELECT CAST(is_cancelled AS INTEGER) AS actual,
                  CAST(score > (SELECT all_rate FROM rates_all) AS INTEGER) AS predicted, count(*) AS count
           FROM scored GROUP BY ALL) c USING (actual, predicted)"""))


_model_sql()


def _stream_sql():
    from ..schema import DEFAULT_ROUTING, DEFAULT_SEVERITY, ROUTING, SEVERITY
    from .oracle import on_tagged, _DASH
    from .sql_base import keywords_sql, lookup_sql
    sql("stream_classify", on_tagged(f"""
SELECT booking_id, airline, booking_channel, booking_status, customer_complaint, category,
       {lookup_sql('category', SEVERITY, DEFAULT_SEVERITY)} AS severity,
       {lookup_sql('category', {k: v[0] for k, v in ROUTING.items()}, DEFAULT_ROUTING[0])} AS routing_team,
       {lookup_sql('category', {k: v[1] for k, v in ROUTING.items()}, DEFAULT_ROUTING[1])} AS routing_action,
       {keywords_sql('lower(customer_complaint)', _DASH)} AS matched_keywords
FROM tagged"""))


_stream_sql()
