"""Eager loading: children as an array of structs in their parent's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def include(parent: DataFrame, child: DataFrame, key: str, fk: str, name: str, where: Column | None = None, order: list | None = None, skip: int = 0, take: int | None = None) -> DataFrame:
    """Each parent with its children (filtered, ordered, paged); an empty array where there are none."""
    c = child if where is None else child.where(where)
    cols = c.columns
    if order:
        c = c.withColumn("_n", F.row_number().over(Window.partitionBy(fk).orderBy(*order)))
        c = c.where((F.col("_n") > skip) & (F.col("_n") <= skip + take if take is not None else F.lit(True)))
    else:
        c = c.withColumn("_n", F.lit(0))
    nested = c.groupBy(F.col(fk).alias("_fk")).agg(F.sort_array(F.collect_list(F.struct("_n", *cols))).alias(name))
    nested = nested.withColumn(name, F.transform(name, lambda x: F.struct(*[x[k].alias(k) for k in cols])))
    empty = F.array().cast(nested.schema[name].dataType)
    return parent.join(nested, parent[key] == F.col("_fk"), "left").drop("_fk").withColumn(name, F.coalesce(name, empty))
