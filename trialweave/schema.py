"""Declared schemas and fixed label sets of the trial tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Arm codes, labels, margin and prior settings that results depend on.
ARMS = ("Ctrl", "H", "L")
CONTROL_ARM = "Ctrl"
SES_LABELS = ("Least disadvantaged", "Most disadvantaged")
REMOTENESS_LABELS = ("Major Cities", "Regional/Remote")
MAJOR_CITY_SOURCE_LABELS = ("Major Cities of Australia",)
LEAST_DISADVANTAGED_SOURCE_LABEL = "2. Least Disadvantaged [NSW 2016]"
REGIONAL_SOURCE_LABEL = "2. Inner/Outer Regional/Remote Australia"
CONTROL_SOURCE_CODE = 2
DECILE_CUT = 6
COHORT_CUT = 62
NONINFERIORITY_MARGIN = 16.4
PRIOR_COEFFICIENT_SD = 1000.0
PRIOR_SCALE = 62.0
PRIOR_SCALE_DF = 3.0
# Seeds of this library's own streams.
ASSIGNMENT_SEED = 410_203
FIT_SEED = 58_771
SENSITIVITY_SEED = 902_441


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


WIDE_SOURCE = _struct(
    ("tname", T.LongType(), False),
    ("schoolid", T.LongType(), False),
    ("stype", T.StringType(), True),
    ("RA_name", T.StringType(), True),
    ("Decile", T.IntegerType(), True),
    ("dose_fin", T.StringType(), True),
    ("base_total_pa_fin", T.DoubleType(), True),
    ("fu_total_pa_fin", T.DoubleType(), True),
    ("Allocation_Date", T.DateType(), True),
)

LONG_SOURCE = _struct(
    ("teacher_IDFIN", T.LongType(), False),
    ("SCHOOLID", T.LongType(), False),
    ("time", T.IntegerType(), True),
    ("total_paCTA", T.DoubleType(), True),
    ("intcont", T.IntegerType(), True),
    ("SEIFACAT16", T.StringType(), True),
    ("RemoteDICHOM16", T.StringType(), True),
    ("STYPE", T.StringType(), True),
    ("Allocation_Date", T.DateType(), True),
)

UNIT_TABLE = _struct(
    ("unit_id", T.LongType(), False),
    ("cluster_id", T.LongType(), True),
    ("stype", T.StringType(), True),
    ("arm", T.StringType(), True),
    ("ses", T.StringType(), True),
    ("remoteness", T.StringType(), True),
    ("baseline", T.DoubleType(), True),
    ("outcome", T.DoubleType(), True),
    ("cohort", T.IntegerType(), True),
)

PREDICTIONS = _struct(
    ("unit_id", T.LongType(), False),
    ("arm", T.StringType(), False),
    ("old_arm", T.StringType(), False),
    ("pred", T.DoubleType(), False),
    ("imp", T.IntegerType(), False),
)
