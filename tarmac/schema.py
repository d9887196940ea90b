"""Schemas, display orders, bands and rule vocabularies.

Everything below the FIXED VALUES marker must equal the behaviour being reproduced
(labels, orders, thresholds, regex patterns); it is data, not logic.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The 23 columns of one booking row, in source order.
BOOKING_SCHEMA = T.StructType([
    T.StructField("booking_id", T.StringType()),
    T.StructField("booking_date", T.DateType()),
    T.StructField("departure_date", T.DateType()),
    T.StructField("lead_time_days", T.LongType()),
    T.StructField("airline", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("haul_type", T.StringType()),
    T.StructField("cabin_class", T.StringType()),
    T.StructField("trip_type", T.StringType()),
    T.StructField("fare_basis", T.StringType()),
    T.StructField("booking_channel", T.StringType()),
    T.StructField("booking_source", T.StringType()),
    T.StructField("pax_count", T.LongType()),
    T.StructField("base_fare_inr", T.DoubleType()),
    T.StructField("taxes_inr", T.DoubleType()),
    T.StructField("total_fare_inr", T.DoubleType()),
    T.StructField("ancillary_revenue_inr", T.DoubleType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("booking_status", T.StringType()),
    T.StructField("prior_bookings", T.LongType()),
    T.StructField("satisfaction_score", T.DoubleType()),
    T.StructField("customer_complaint", T.StringType()),
])

BOOKING_COLUMNS = [f.name for f in BOOKING_SCHEMA.fields]
NUMERIC_COLUMNS = [f.name for f in BOOKING_SCHEMA.fields
                   if isinstance(f.dataType, (T.LongType, T.DoubleType))]

# ---------------------------------------------------------------------------
# FIXED VALUES - labels, orders, thresholds and patterns of the analysis.
# ---------------------------------------------------------------------------

CANCELLED_STATUSES = ["Cancelled", "Refunded"]

MONTHS_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
                "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

CABIN_ORDER = ["Economy", "Premium Economy", "Business", "First"]

# The nine categorical columns profiled one after another in the EDA.
PROFILED_CATEGORICALS = ["airline", "haul_type", "cabin_class", "trip_type", "booking_channel",
                         "booking_source", "payment_method", "booking_status", "customer_complaint"]

# Eight numeric columns of the correlation matrix, in display order.
CORRELATION_COLUMNS = ["lead_time_days", "pax_count", "base_fare_inr", "taxes_inr",
                       "total_fare_inr", "ancillary_revenue_inr", "prior_bookings",
                       "satisfaction_score"]

# Columns correlated with the 0/1 cancellation target.
TARGET_CORRELATION_COLUMNS = ["lead_time_days", "total_fare_inr", "base_fare_inr",
                              "pax_count", "prior_bookings"]

# Right-closed bands: (edges, labels).  Value v gets label i when edges[i] < v <= edges[i+1].
BOOKING_WINDOW_BANDS = ([0, 7, 30, 90, 365],
                        ["Last_Minute", "Short_Term", "Planned", "Early_Bird"])
LOYALTY_BANDS = ([-1, 0, 5, 10, 100],
                 ["New", "Occasional", "Regular", "Frequent"])
LEAD_TIME_BANDS_APP = ([0, 7, 30, 90, 180, 365],
                       ["0–7d", "8–30d", "31–90d", "91–180d", "181d+"])
LEAD_TIME_BANDS_NOTEBOOK = ([0, 7, 30, 90, 180, 365],
                            ["0-7d", "8-30d", "31-90d", "91-180d", "181d+"])
FARE_QUINTILE_LABELS = ["Q1\n(Lowest)", "Q2", "Q3", "Q4", "Q5\n(Highest)"]

CUSTOMER_TYPE_APP = ("Repeat", "New")
CUSTOMER_TYPE_NOTEBOOK = ("Repeat Customer", "New Customer")

ROUTE_SEP_APP = " → "
ROUTE_SEP_NOTEBOOK = "-"

# Risk tiers on the cancellation probability in percent: (minimum, label, action).
RISK_TIERS = [
    (60.0, "🔴 HIGH RISK", "⚠️ Flag for proactive agent outreach. Consider mandatory deposit."),
    (35.0, "🟡 MEDIUM RISK", "ℹ️ Monitor booking. Send automated confirmation reminder."),
    (None, "🟢 LOW RISK", "✅ Standard processing. No intervention required."),
]

# Complaint taxonomy of the dashboard, in priority order: category -> regex patterns.
DASHBOARD_RULES = [
    ("Schedule / Delay", [
        r"\bdelay\w*\b", r"\bschedule\b", r"\bflight cancell\w*\b", r"\bdiverted\b",
        r"\bmissed\b", r"\bpostponed\b", r"\breschedul\w+\b", r"\blate\b",
    ]),
    ("Refund Issues", [
        r"\brefund\w*\b", r"\bmoney back\b", r"\breimburse\w*\b",
        r"\bno refund\b", r"\bnot refunded\b", r"\brefund pending\b",
    ]),
    ("Ticketing Issues", [
        r"\bticket\w*\b", r"\bPNR\b", r"\bbooking error\b", r"\bname change\b",
        r"\bincorrect\b", r"\bwrong\b", r"\bduplicate\b", r"\bnot issued\b",
    ]),
    ("Payment / Pricing", [
        r"\bprice\w*\b", r"\bovercharg\w+\b", r"\bhidden fee\b", r"\bfare\b",
        r"\bextra charge\b", r"\bcharged\b", r"\bpayment\b", r"\bbilling\b",
    ]),
    ("Baggage", [
        r"\bbaggage\b", r"\bluggage\b", r"\bbag\b", r"\bsuitcase\b",
        r"\blost bag\b", r"\bdamaged\b", r"\bmissing bag\b",
    ]),
    ("Seat Issues", [
        r"\bseat\b", r"\bseating\b", r"\bupgrade\b", r"\blegroom\b",
        r"\bassignment\b", r"\bno seat\b", r"\bseat change\b",
    ]),
    ("Visa / Documentation", [
        r"\bvisa\b", r"\bdocument\w*\b", r"\bpassport\b", r"\bimmigration\b",
        r"\bentry\b", r"\bdeniedd?\b", r"\bclearance\b",
    ]),
    ("Ancillary Services", [
        r"\bmeal\b", r"\bfood\b", r"\bwi-?fi\b", r"\bentertainment\b",
        r"\blounge\b", r"\bancillar\w*\b", r"\bspecial assistance\b",
    ]),
    ("Customer Service", [
        r"\brude\b", r"\bunhelpful\b", r"\bstaff\b", r"\bagent\b",
        r"\bno response\b", r"\bwait\w*\b", r"\bcustomer service\b",
    ]),
]

# Complaint taxonomy of the NLP notebook, in priority order.
NOTEBOOK_RULES = [
    ("Refund Issues", [
        r"\brefund\w*\b", r"\bnot refunded\b", r"\breimburse\w*\b", r"\bmoney back\b",
        r"\brefund not processed\b",
    ]),
    ("Ticketing Issues", [
        r"\bticket\w*\b", r"\bpnr\b", r"\bname spelling\b", r"\bname correction\b",
        r"\bname change\b", r"\bnot issued\b", r"\bbooking error\b", r"\bairline system\b",
    ]),
    ("Payment / Pricing Issues", [
        r"\bduplicate charge\b", r"\bcredit card\b", r"\bcharged\b", r"\bpricing\b",
        r"\bfare difference\b", r"\bincorrect fare\b", r"\bovercharg\w*\b", r"\bcost\b",
        r"\bprice\b",
    ]),
    ("Baggage Issues", [
        r"\bbaggage\b", r"\bluggage\b", r"\bbag\b", r"\blost bag\b", r"\bdelayed bag\b",
        r"\bextra baggage\b", r"\bnot received\b",
    ]),
    ("Seat Issues", [
        r"\bseat\b", r"\bwindow\b", r"\bmiddle\b", r"\ballocation\b",
    ]),
    ("Schedule / Delay Issues", [
        r"\bdelay\w*\b", r"\bschedule\b", r"\bflight delayed\b", r"\bcompensation\b",
        r"\bmissed connection\b", r"\bconnection time\b", r"\breschedul\w*\b",
    ]),
    ("Visa / Documentation Issues", [
        r"\bvisa\b", r"\bpassport\b", r"\bdocument\b",
    ]),
    ("Ancillary Service Issues", [
        r"\bmeal\b", r"\bemd\b", r"\bancillary\b", r"\bservice not reflecting\b",
    ]),
]

OTHER_CATEGORY = "Other"
NO_COMPLAINT = "No Complaint"
# Texts (lower-cased, trimmed) that the notebook classifier treats as "no complaint".
NO_COMPLAINT_TEXTS = ["", "nan", "no"]

# Severity per dashboard category; anything else is Low.
SEVERITY = {
    "Refund Issues": "High",
    "Schedule / Delay": "High",
    "Payment / Pricing": "High",
    "Ticketing Issues": "Medium",
    "Baggage": "Medium",
    "Customer Service": "Medium",
    "Seat Issues": "Low",
    "Visa / Documentation": "Low",
    "Ancillary Services": "Low",
    "Other": "Low",
}
DEFAULT_SEVERITY = "Low"

# Routing per dashboard category: (team, action).
ROUTING = {
    "Schedule / Delay": ("🛫 Ops / Airline Liaison", "Contact airline ops team to check IROPS status."),
    "Refund Issues": ("💰 Finance / Refunds Team", "Escalate to finance for refund processing. Check fare rules."),
    "Ticketing Issues": ("🔧 NDC/GDS Tech Team", "Investigate PNR via GDS terminal or NDC API logs."),
    "Payment / Pricing": ("📊 Revenue Management", "Check if fare discrepancy is in airline price cache."),
    "Baggage": ("🧳 Airport Services", "Raise PIR with originating airport. Track via WorldTracer."),
    "Seat Issues": ("🪑 Ground Services", "Check seat availability and reassign via PSS."),
    "Visa / Documentation": ("📋 Documentation Team", "Verify travel documents and advise on entry requirements."),
    "Ancillary Services": ("🍽️ Inflight Services", "Coordinate with airline catering/inflight services."),
    "Customer Service": ("👥 Agent Relations", "Flag to agent quality team for coaching."),
    "Other": ("📩 General Support", "Route to Tier 1 support for manual triage."),
}
DEFAULT_ROUTING = ("📩 General Support", "Manual review required.")

# Model feature sets.
APP_CATEGORICAL_FEATURES = ["airline", "cabin_class", "trip_type",
                            "booking_channel", "booking_source", "haul_type"]
APP_NUMERIC_FEATURES = ["lead_time_days", "pax_count", "base_fare_inr", "taxes_inr",
                        "total_fare_inr", "prior_bookings", "fare_per_passenger",
                        "booking_month", "booking_dayofweek", "is_repeat_customer",
                        "has_ancillary", "fare_to_avg_route_fare", "tax_ratio"]
NOTEBOOK_CATEGORICAL_FEATURES = ["airline", "haul_type", "cabin_class", "trip_type", "fare_basis",
                                 "booking_channel", "booking_source", "payment_method", "route",
                                 "booking_day", "travel_month", "booking_window", "loyalty_segment",
                                 "lead_time_bin", "fare_quintile", "booking_month_name",
                                 "customer_type"]
NOTEBOOK_NUMERIC_FEATURES = ["lead_time_days", "pax_count", "base_fare_inr", "taxes_inr",
                             "total_fare_inr", "ancillary_revenue_inr", "prior_bookings",
                             "satisfaction_score", "booking_month", "fare_per_passenger"]

RETRIEVAL_TOP_K = 8
EMBED_BATCH = 128
