"""Marks that compare the rows of a small report with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def flag_above_mean(df: DataFrame, column: str, name: str = "above_mean") -> DataFrame:
    """Mark rows at or above the mean of the report."""
    mean = df.agg(F.avg(column)).scalar()
    return df.withColumn(name, F.round(F.col(column), 6) >= F.round(mean, 6))


def flag_extremes(df: DataFrame, column: str, name: str = "extreme") -> DataFrame:
    """Mark the largest and smallest value of the report; a lone value counts as largest."""
    ends = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    value = F.col(column)
    return (
        df.withColumn("_ends", ends)
        .withColumn(name, F.when(value == F.col("_ends.high"), "max")
                    .when(value == F.col("_ends.low"), "min").otherwise("other"))
        .drop("_ends")
    )
