"""Independent DuckDB SQL for every registered query (correctness oracle).

The canonical tables are CTEs over the raw test tables built from the same
adapter text as the Spark side; everything above them is written from the
column definitions over per-order blocks.
"""

from marketlens.oracle import model_kpi, storage  # noqa: F401  (register M and K, I and L)
from marketlens.oracle.queries import Q as ORACLE_SQL  # noqa: F401
