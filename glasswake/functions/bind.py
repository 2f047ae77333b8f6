"""Computing an expensive column exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose value later filters and projections cannot inline.

    The optimizer copies a plain column's expression into every filter pushed below
    it; a chain of such columns grows exponentially.  The output of a one-element
    explode is a plan boundary, stays inside code generation and adds no shuffle.
    """
    if name in df.columns:
        df = df.withColumnRenamed(name, name + "__in")
    out = df.select("*", F.explode(F.array(value)).alias(name))
    return out.drop(name + "__in")
