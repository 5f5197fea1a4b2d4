"""Reading source files and keeping stage tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.session import cut_lineage

MISSING_MARK = "NA"


def read_units_csv(
    spark: SparkSession, path: str, schema: T.StructType, blank_text: Sequence[str] = ()
) -> DataFrame:
    """CSV with a header, the missing mark ``NA`` and declared types; unreadable fields are NULL.

    Blank fields are missing, except in the text columns named in ``blank_text``, where a blank is
    empty text. NaN in number columns becomes NULL.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if not blank_text:
        fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
        df = reader.schema(T.StructType(fields)).option("nullValue", MISSING_MARK).csv(path)
        return df.select(*[_clean(f, F.col(f.name)).alias(f.name) for f in schema.fields])
    fields = [T.StructField(f.name, T.StringType(), True) for f in schema.fields]
    df = reader.schema(T.StructType(fields)).csv(path)
    out = []
    for f in schema.fields:
        text = F.nullif(F.col(f.name), F.lit(MISSING_MARK))
        if f.name in blank_text:
            text = F.when(F.col(f.name).isNull(), F.lit("")).otherwise(text)
        out.append(_clean(f, text.try_cast(f.dataType)).alias(f.name))
    return df.select(*out)


def _clean(field: T.StructField, c):
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


@dataclass(frozen=True)
class CheckedCsv:
    """``rows(file, the declared columns)``, ``quarantine(file, line)``, ``headers(file, missing, unknown)``."""

    rows: DataFrame
    quarantine: DataFrame
    headers: DataFrame
    counts: DataFrame


def read_checked_csv(spark: SparkSession, path: str, schema: T.StructType) -> CheckedCsv:
    """CSV files read by the names in their own headers, with what could not be read set apart and counted.

    Columns may stand in another order in each file. A line with more or fewer fields than its file's header goes to
    ``quarantine`` as it is. A field that is there but no value of its type is NULL in ``rows``; ``counts(file,
    column_name, n_rows, n_unreadable)`` has their number from one pass. ``headers`` lists declared columns that a
    file lacks (NULL in its rows) and columns it has besides. Lines are records: no line breaks inside quotes.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    # the first line of a file is the first row of the split that starts it
    heads = lines.where("_start = 0").groupBy("file").agg(F.min_by("line", "_at").alias("_head"))
    heads = cut_lineage(heads.select("file", "_head", _fields("_head").alias("_names")), "headers")
    declared = F.array(*[F.lit(f.name) for f in schema.fields])
    faults = heads.select(
        "file",
        F.array_except(declared, "_names").alias("missing"),
        F.array_except("_names", declared).alias("unknown"),
    ).where((F.size("missing") > 0) | (F.size("unknown") > 0))
    parsed = lines.join(heads, "file").where((F.col("line") != F.col("_head")) & (F.trim("line") != ""))
    parsed = parsed.select("file", "line", "_names", _fields("line").alias("_values"))
    whole = F.size("_values") == F.size("_names")
    kept = parsed.where(whole)
    raw = [
        F.nullif(F.nullif(F.get("_values", F.array_position("_names", f.name).cast("int") - 1), F.lit(MISSING_MARK)), F.lit(""))
        for f in schema.fields
    ]
    named = kept.select("file", *[F.when(F.array_contains("_names", f.name), c).alias(f.name) for f, c in zip(schema.fields, raw)])
    typed = named.select(
        "file", *[_clean(f, F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema.fields]
    )
    bad = [F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in schema.fields]
    cells = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("n_unreadable")) for f in schema.fields])
    counts = named.groupBy("file").agg(F.count("*").alias("n_rows"), *bad).select("file", "n_rows", F.inline(cells))
    return CheckedCsv(typed, parsed.where(~whole).select("file", "line"), faults, counts)


def _fields(line: str):
    """The fields of a line; a quoted field may hold commas and doubled quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), F.col(line)), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(
        found, lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')).otherwise(F.trim(x))
    )


def write_units_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("nullValue", MISSING_MARK).csv(path)


def save_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Keep a stage table as parquet; imputed tables are partitioned by ``imp``."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)
