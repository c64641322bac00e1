"""Table schemas and the read boundary's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIT = T.StructType(
    [
        T.StructField("actor_id", T.StringType()), T.StructField("signal_id", T.StringType()),
        T.StructField("event_date", T.TimestampNTZType()), T.StructField("pub_date", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()), T.StructField("source", T.StringType()), T.StructField("vintage_id", T.StringType()),
    ]
)
ACTOR = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("actor_id", "name", "actor_type")]
    + [T.StructField("layer", T.IntegerType()), T.StructField("geography", T.StringType()), T.StructField("sector", T.StringType()), T.StructField("external_ids", T.MapType(T.StringType(), T.StringType()))]
)

#: Actor types, layers and decomposition methods.
ACTOR_TYPES = (
    "global_shock", "central_bank", "regulator", "think_tank", "intl_org", "large_firm",
    "bank", "sector_leader", "sme", "municipality", "household", "retail_investor",
)
DECOMPOSITIONS = ("schur", "directed_variation", "polar", "hermitian_dilation", "dmd", "extended_dmd")
LAYERS = (0, 1, 2, 3)


def assert_columns(df: DataFrame, required: list[str] | tuple[str, ...]) -> DataFrame:
    """``df`` itself, or a ValueError that names the columns it lacks."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark's aggregates take NaN for a value; inside this library missing is null only."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema))
