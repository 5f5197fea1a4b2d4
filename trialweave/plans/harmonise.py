"""From two raw trial tables to one unit table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.recode import (
    cohort_flag,
    id_number,
    recode_equal,
    recode_member,
    recode_threshold,
    with_levels,
)
from trialweave.operators.reshape import time_columns, union_fill
from trialweave.schema import (
    ARMS,
    COHORT_CUT,
    CONTROL_SOURCE_CODE,
    DECILE_CUT,
    LEAST_DISADVANTAGED_SOURCE_LABEL,
    MAJOR_CITY_SOURCE_LABELS,
    REGIONAL_SOURCE_LABEL,
    REMOTENESS_LABELS,
    SES_LABELS,
    UNIT_TABLE,
)

TIMES = {1: "baseline", 2: "outcome"}


def recode_wide(
    wide: DataFrame,
    city_labels: Sequence[str] = MAJOR_CITY_SOURCE_LABELS,
    arms: Sequence[str] = ARMS,
) -> DataFrame:
    """Trial with one row per unit: labels from decile, remoteness class and arm code.

    Ids that are no number become missing; rows without a unit id are left out (``unreadable_ids`` counts).
    """
    least, most = SES_LABELS
    city, regional = REMOTENESS_LABELS
    return wide.select(
        id_number("tname").alias("unit_id"),
        id_number("schoolid").alias("cluster_id"),
        "stype",
        with_levels("dose_fin", arms).alias("arm"),
        recode_threshold("Decile", DECILE_CUT, most, least).alias("ses"),
        recode_member("RA_name", city_labels, city, regional).alias("remoteness"),
        F.col("base_total_pa_fin").alias("baseline"),
        F.col("fu_total_pa_fin").alias("outcome"),
    ).where("unit_id is not null")


def recode_long(
    rows: DataFrame,
    control_code: int = CONTROL_SOURCE_CODE,
    least_label: str = LEAST_DISADVANTAGED_SOURCE_LABEL,
    regional_label: str = REGIONAL_SOURCE_LABEL,
) -> DataFrame:
    """Trial with one row per unit and time: attributes of the first row plus both measurements.

    First row and measurements are aggregates of the same unit, so one shuffle on the unit gives
    both; the smallest (time, attributes) struct is the first row, missing times last. Rows whose unit
    id is missing or no number are left out.
    """
    least, most = SES_LABELS
    city, regional = REMOTENESS_LABELS
    attributes = {
        "cluster_id": id_number("SCHOOLID"),
        "stype": F.col("STYPE"),
        "arm": recode_equal("intcont", control_code, "Ctrl", "H"),
        "ses": recode_equal("SEIFACAT16", least_label, least, most),
        "remoteness": recode_equal("RemoteDICHOM16", regional_label, regional, city),
    }
    first = F.min(
        F.struct(
            F.col("time").isNull().alias("untimed"),
            F.col("time"),
            *[c.alias(name) for name, c in attributes.items()],
        )
    ).alias("first")
    return (
        rows.withColumn("unit_id", id_number("teacher_IDFIN"))
        .where("unit_id is not null")
        .groupBy("unit_id")
        .agg(first, *time_columns("time", "total_paCTA", TIMES))
        .select("unit_id", *[f"first.{name}" for name in attributes], *TIMES.values())
    )


def harmonise_trials(
    wide: DataFrame,
    rows: DataFrame,
    cohort_cut: int | Column = COHORT_CUT,
    city_labels: Sequence[str] = MAJOR_CITY_SOURCE_LABELS,
    arms: Sequence[str] = ARMS,
) -> DataFrame:
    """Both trials in one unit table, with the cohort flag from the cluster id."""
    units = union_fill(recode_long(rows), recode_wide(wide, city_labels, arms))
    flagged = units.withColumn("cohort", cohort_flag("cluster_id", cohort_cut))
    return flagged.select(*UNIT_TABLE.fieldNames())


def unreadable_ids(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per id column, how many present values are no number and become missing: (column_name, n_unreadable)."""
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count_if(F.col(c).isNotNull() & id_number(c).isNull()).alias("n_unreadable"),
        )
        for c in columns
    ]
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))
