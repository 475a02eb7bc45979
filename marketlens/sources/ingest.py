"""Sources: CSV ingest with type repair, Parquet load, database and zip dimension.

The source pipeline imports nine CSV files with deliberately wrong types and
repairs them afterwards.  Here every CSV column is read as a string with an
explicit schema (never ``inferSchema``, which would scan the data twice) and
then cast with ``try_cast``: a row whose non-null text does not convert goes
to quarantine with its reason, column and file instead of failing the job or
silently turning null.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from marketlens.schema import CSV_NAMES, SCHEMAS
from marketlens.sources.adapter import adapt, read_raw


CORRUPT, FILE, REASON = "_corrupt_record", "_file", "_reason"


def _first_lines(spark: SparkSession, path: str) -> dict[str, str]:
    """File -> its first line, for a file or a folder of files; empty files and
    names that begin with ``_`` or ``.`` are left out, as in any Spark read.
    Only the first block of a file is opened, by the driver."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(status) -> tuple[str, str | None]:
        file = status.getPath()
        stream = fs.open(file)
        try:
            codec = codecs.getCodec(file)
            plain = codec.createInputStream(stream) if codec else stream
            return file.toString(), jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
        finally:
            stream.close()

    found = [s for s in fs.listStatus(root) if s.isFile() and s.getLen() and s.getPath().getName()[0] not in "_."]
    with ThreadPoolExecutor(16) as pool:
        return {f: line for f, line in pool.map(first, found) if line is not None}


def ingest_csv(spark: SparkSession, path: str, table: str,
               names: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """Read one CSV export as all-string columns (I1), bound by header name.

    ``names`` maps a table to its file name (without ``.csv``) when the export
    does not use the table names; the name may be that of a folder of files.
    Every file is bound by its own header: files of one header are one scan, and
    the scans are united.  Columns may come in any order, and further ones are
    left out; a file that lacks one raises.  A row with too few or too many
    fields keeps its text in ``_corrupt_record``; ``_file`` is the row's file.
    ``multi_line`` allows quoted newlines inside a record; files are then read
    whole, one task each.
    """
    file = f"{path}/{(names or {}).get(table, CSV_NAMES[table])}.csv"
    wanted = [f.name for f in SCHEMAS[table].fields]
    headers: dict[tuple[str, ...], list[str]] = {}
    for f, line in sorted(_first_lines(spark, file).items()):
        header = tuple(next(csv.reader([line.removeprefix("\ufeff")])))
        headers.setdefault(header, []).append(f)
    if not headers:
        raise ValueError(f"{file} has no header")
    for header, files in headers.items():
        missing = [c for c in wanted if c not in header]
        if missing:
            raise ValueError(f"{files[0]} has no column {', '.join(missing)}")

    def scan(header: tuple[str, ...], files: list[str]) -> DataFrame:
        # columns that nobody asked for, or that come again, are bound by place alone
        bound = [c if c in wanted and header.index(c) == i else f"_other{i}" for i, c in enumerate(header)]
        schema = StructType([StructField(c, StringType(), True) for c in [*bound, CORRUPT]])
        rows = (spark.read.option("header", True).option("escape", '"').schema(schema)
                .option("multiLine", multi_line).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(files))
        # Spark refuses a scan of the corrupt text alone, so it comes with a column (the condition always holds)
        return rows.select(*wanted, F.when(F.length(F.concat_ws("", wanted[0])) >= 0, F.col(CORRUPT)).alias(CORRUPT),
                           F.col("_metadata.file_path").alias(FILE))

    return reduce(DataFrame.unionByName, [scan(h, f) for h, f in headers.items()])


def _typed(col: str, dtype) -> F.Column:
    if isinstance(dtype, StringType):
        return F.col(col)
    target = "timestamp_ntz" if isinstance(dtype, TimestampNTZType) else dtype.simpleString()
    return F.expr(f"try_cast(trim(`{col}`) as {target})")


def _faults(df: DataFrame, schema: StructType) -> dict[str, F.Column]:
    """Fault -> whether a row has it: a column whose non-blank text is not of
    its type, or ``malformed``, a row of too few or too many fields."""
    out = {f.name: F.col(f.name).isNotNull() & (F.trim(F.col(f.name)) != "") & _typed(f.name, f.dataType).isNull()
           for f in schema.fields if not isinstance(f.dataType, StringType)}
    if CORRUPT in df.columns:
        out["malformed"] = F.col(CORRUPT).isNotNull()
    return out


def _reason(faults: dict[str, F.Column]) -> F.Column:
    """Names of the faults of a row, comma-joined in the schema's order; a
    malformed row has that one alone; null for a good row."""
    bad = F.array_join(F.array_compact(F.array(*[F.when(is_, F.lit(n)) for n, is_ in faults.items() if n != "malformed"])), ",")
    named = F.when(bad != "", bad)
    return F.when(faults["malformed"], F.lit("malformed")).otherwise(named) if "malformed" in faults else named


def retype(df: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Cast string columns to ``schema`` (I2) -> (good rows, quarantined rows).

    A row is quarantined when any non-null, non-blank source value fails to
    convert, or when it had too few or too many fields; ``_reason`` names the
    columns.  Both outputs are lazy and each reads the source; ``import_csv``
    reads it once.
    """
    judged = df.withColumn(REASON, _reason(_faults(df, schema)))
    good = judged.where(F.col(REASON).isNull()).select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema.fields])
    return good, judged.where(F.col(REASON).isNotNull())


def load_csv(spark: SparkSession, path: str, names: dict[str, str] | None = None,
             multi_line: frozenset[str] = frozenset()) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """All nine tables from a CSV export -> (canonical tables, quarantines), lazy.
    ``multi_line`` names the tables whose files hold quoted newlines."""
    good, bad = {}, {}
    for table, schema in SCHEMAS.items():
        good[table], bad[table] = retype(
            ingest_csv(spark, path, table, names, table in multi_line), schema)
    return good, bad


def import_table(raw: DataFrame, schema: StructType, store: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """One pass over ``raw``: typed rows and quarantined rows, with their text,
    ``_reason`` and ``_file``, go to two folders under ``store``; the counts
    (``rows``, ``rejected`` and one per fault) are observed on the way."""
    spark, seen = raw.sparkSession, Observation()
    faults = _faults(raw, schema)
    text = [c for c in (*schema.names, CORRUPT, FILE) if c in raw.columns]
    judged = raw.withColumn(REASON, _reason(faults)).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count(REASON).alias("rejected"),
        *[F.count_if(is_).alias(f"fault_{n}") for n, is_ in faults.items()])
    bad = F.col(REASON).isNotNull()
    kept = [F.when(~bad, _typed(f.name, f.dataType)).alias(f.name) for f in schema.fields]
    source = F.when(bad, F.struct(*text)).alias("_source")
    judged.select(*kept, REASON, source, F.when(bad, "bad").otherwise("good").alias("_part")).write.mode(
        "overwrite").partitionBy("_part").parquet(store)
    stored = StructType([StructField(f.name, f.dataType, True) for f in schema.fields]
                        + [StructField(REASON, StringType()), StructField("_source", StructType([StructField(c, StringType()) for c in text])),
                           StructField("_part", StringType())])
    back = spark.read.schema(stored).parquet(store)
    return (back.where("_part = 'good'").select(*schema.names),
            back.where("_part = 'bad'").select("_source.*", REASON), dict(seen.get))


def import_csv(spark: SparkSession, path: str, store: str, names: dict[str, str] | None = None,
               multi_line: frozenset[str] = frozenset(), tables: tuple[str, ...] = tuple(SCHEMAS)
               ) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, dict[str, int]]]:
    """``load_csv`` with every file read once: (tables, quarantines, counts),
    Parquet below ``store``."""
    out = {t: import_table(ingest_csv(spark, path, t, names, t in multi_line), SCHEMAS[t], f"{store}/{t}") for t in tables}
    return tuple({t: parts[i] for t, parts in out.items()} for i in range(3))


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Canonical tables from the Parquet test tables in ``sf_dir``."""
    return adapt(read_raw(spark, sf_dir))


def create_database(spark: SparkSession, name: str, drop: bool = False) -> None:
    """Drop (only when asked), create and select a database."""
    if drop and spark.catalog.databaseExists(name):
        spark.sql(f"DROP DATABASE `{name}` CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    spark.catalog.setCurrentDatabase(name)


def zip_dimension(t: dict[str, DataFrame]) -> DataFrame:
    """Distinct zip prefixes of the geolocation table (I4)."""
    return (t["geolocation"].select("geolocation_zip_code_prefix")
            .where(F.col("geolocation_zip_code_prefix").isNotNull())
            .distinct())


def with_zip(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``t`` with its zip dimension, which is derived unless it is there."""
    return t if "zip" in t else {**t, "zip": zip_dimension(t)}
