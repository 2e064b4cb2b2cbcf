"""Target dimension: defaults overridden per target, and checks of its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_targets(targets: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fill unset columns from `defaults`; derive name, first url and keyword lists.

    `targets` has target_id, name, urls and any of the default columns, among
    them the map `keyword_groups`.
    """
    out = targets
    for column, value in defaults.items():
        own = F.col(column) if column in targets.columns else F.lit(None)
        out = out.withColumn(column, F.coalesce(own, value))
    groups = F.coalesce(F.col("keyword_groups"), F.create_map().cast("map<string,array<string>>"))
    none = F.array().cast("array<string>")
    return (
        out.withColumn("name", F.coalesce(F.col("name"), F.col("target_id")))
        .withColumn("primary_url", F.get(F.col("urls"), F.lit(0)))
        .withColumn("keyword_groups", groups)
        .withColumn("cfp_keywords", F.coalesce(F.try_element_at(groups, F.lit("cfp")), none))
        .withColumn("no_dates_keywords", F.coalesce(F.try_element_at(groups, F.lit("no_dates")), none))
        .withColumn("all_keywords", F.transform(F.flatten(F.map_values(groups)), F.lower))
    )


def config_violations(targets: DataFrame) -> DataFrame:
    """One row per broken rule; no rows for a usable table.

    A target without an id or without urls breaks a rule, and so does a table
    without targets.
    """
    rules = [
        ("missing_id", F.col("target_id").isNull()),
        ("missing_urls", F.col("urls").isNull()),
        ("empty_urls", F.size("urls") == 0),
    ]
    broken = F.filter(
        F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules]), lambda r: r.isNotNull()
    )
    rows = targets.select("target_id", F.explode(broken).alias("rule"))
    empty = targets.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("target_id"), F.lit("no_targets").alias("rule")
    )
    return reduce(DataFrame.unionByName, [rows, empty])
