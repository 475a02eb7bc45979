"""Column-level helpers (built-in Spark expressions only, no Python UDFs)."""

from marketlens.functions.columns import (at_least_one, avg_days, fixed, bucketize,  # noqa: F401
                                          day_diff, grade, int_div,
                                          normalize_text, pct, ratio,
                                          safe_ratio, status_label)
