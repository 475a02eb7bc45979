"""marketlens: marketplace analytics as plain Spark DataFrame plans.

Layers (each a sub-package):

* ``sources``   – test-table adapter, CSV ingest with type repair, layout writer
* ``functions`` – column-level helpers (day difference, safe ratios, buckets…)
* ``operators`` – reusable DataFrame operators (top-n, ranking, shares, checks)
* ``plans``     – the six views, the business questions, the star model and
                  the measures, each ``f(t, **opts) -> DataFrame``
* ``oracle``    – independent DuckDB SQL for every registered query

``t`` is always the dict of canonical tables returned by
:func:`marketlens.sources.load`.
"""

from marketlens.sources import load  # noqa: F401

__all__ = ["load"]
