"""Reusable DataFrame operators."""

from marketlens.operators.quality import (fk_violations, key_report, null_counts,  # noqa: F401
                                          pk_violations)
from marketlens.operators.ranking import (dense_rank_all, rank_by, row_numbers,  # noqa: F401
                                          top_n, top_n_per_group, top_n_ranked)
from marketlens.operators.shares import (conditional_share, period_growth,  # noqa: F401
                                         share_of_top_n)
