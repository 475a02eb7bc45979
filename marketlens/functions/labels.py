"""Display labels and thresholds used by the business queries.

The oracle states the bucket and grade values again for itself.
"""

# Delivery-day buckets of the satisfaction question: (low, high, label),
# inclusive bounds, checked in this order; anything else is OTHER_BUCKET.
DAY_BUCKETS = [
    (0, 5, "0-5 days"),
    (6, 10, "6-10 days"),
    (11, 20, "11-20 days"),
    (21, 30, "21-30 days"),
]
OTHER_BUCKET = "30+ days"
INVALID_BUCKET = "invalid"          # clean variant: delivery before purchase

# Grades of the category review average.  Faithful form: exact equality with
# the score; clean form: lower bounds checked from the top.
GRADE_EXACT = [(5, "excellent"), (4, "very_good"), (3, "good"), (2, "fair")]
GRADE_RANGES = [(4.5, "excellent"), (3.5, "very_good"), (2.5, "good"), (1.5, "fair")]
GRADE_DEFAULT = "poor"

# Display labels of the eight order status codes.
STATUS_LABELS = {
    "approved": "Approved",
    "canceled": "Canceled",
    "created": "Created",
    "delivered": "Delivered",
    "invoiced": "Invoiced",
    "processing": "Processing",
    "shipped": "Shipped",
    "unavailable": "Unavailable",
}

# Review scores at or below this are "negative" (measure K17).
NEGATIVE_SCORE = 2

# Accented lower-case letters folded by normalize_text (applied after
# lower-casing), and their plain forms, position by position.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
UNACCENTED = "aaaaaeeeeiiiiooooouuuucn"
