"""The source pipeline's three entry points as functions.

A. ``setup``          create the database, load (CSV with type repair, or the
                      Parquet test tables), check keys, stage with layouts.
B. queries            the views and questions of ``registry.QUERIES`` over the
                      tables ``setup`` returns.
C. ``refresh_model``  build the star model and hand it to a BI tool as Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from marketlens.operators.quality import key_report
from marketlens.plans import model as M
from marketlens.schema import FOREIGN_KEYS, PRIMARY_KEYS
from marketlens.sources import (create_database, export_model, import_csv, load, new_folder,
                                stage_tables)

T = dict[str, DataFrame]


def constraint_report(t: T) -> DataFrame:
    """One row per declared key: kind, name, violating key values and rows, all
    judged in one pass over the tables; zero everywhere for a sound set.  The
    zip dimension is the distinct zips of the geolocation table unless ``t`` has
    a table of its own."""
    return key_report(t, PRIMARY_KEYS, FOREIGN_KEYS, derived={} if "zip" in t else {"zip": "geolocation"})


@dataclass
class SetupResult:
    tables: T
    quarantine: T
    report: DataFrame
    #: per table of a CSV import the rows read and rejected, in all and by column
    counts: dict[str, dict[str, int]] = field(default_factory=dict)


def setup(spark: SparkSession, source: str, *, fmt: str = "parquet-test",
          database: str = "marketplace", buckets: int | None = None,
          stage: bool = True, multi_line: frozenset[str] = frozenset()) -> SetupResult:
    """Entry point A: database -> load -> type repair -> key checks -> layout.

    ``fmt`` is ``"csv"`` (the nine exported CSV files, typed with quarantine)
    or ``"parquet-test"`` (the TPC-H-like test tables through the adapter).
    With ``stage`` the tables are written once with their layouts and the
    staged tables are returned; ``buckets`` buckets the order grain (about its
    size divided by 256 MB), without it those tables are sorted by range.
    ``multi_line`` names the tables whose CSV files hold quoted newlines.  Each
    CSV file is read once: typed and quarantined rows go to the session's shared
    folder and are counted on the way.
    """
    create_database(spark, database)
    counts: dict[str, dict[str, int]] = {}
    if fmt == "csv":
        tables, quarantine, counts = import_csv(spark, source, new_folder(spark, "import"), multi_line=multi_line)
    elif fmt == "parquet-test":
        tables, quarantine = load(spark, source), {}
    else:
        raise ValueError(fmt)
    if stage:
        tables = stage_tables(spark, tables, database=database, buckets=buckets)
    return SetupResult(tables, quarantine, constraint_report(tables), counts)


MODEL_TABLES = {
    "fact_order_items": M.fact_order_items,
    "dim_order_hub": M.order_hub,
    "dim_customer": M.dim_customer,
    "dim_seller": M.dim_seller,
    "dim_product": M.dim_product,
    "dim_order_payments": M.order_payments_model,
    "calendar": M.calendar,
}


def refresh_model(t: T, path: str) -> list[str]:
    """Entry point C: build the star model tables and write them as Parquet."""
    tables = {name: fn(t) for name, fn in MODEL_TABLES.items()}
    export_model(tables, path)
    return list(tables)
