"""Exact membership of component names in the dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlens.functions.cpe import ABSENT, present

ACTIVE, DEPRECATED, MISSING = "OFFICIAL_ACTIVE", "OFFICIAL_DEPRECATED", "NOT_IN_DICTIONARY"
MATCH_STATUSES = (ACTIVE, DEPRECATED, MISSING, ABSENT)


def match_status(cpe: Column, deprecated: Column) -> Column:
    """deprecated is null where no dictionary row was joined."""
    return F.when(~present(cpe), ABSENT).when(deprecated.isNull(), MISSING).when(deprecated, DEPRECATED).otherwise(ACTIVE)


def distinct_names(components: DataFrame, column: str = "cpe") -> DataFrame:
    """The names to look up, each once; null and '' become one row ''."""
    return components.select(F.coalesce(column, F.lit("")).alias("cpe")).distinct()


def dictionary_keys(names: DataFrame) -> DataFrame:
    """(cpe, name_id, deprecated); a name that stands twice raises when it is read."""
    grouped = names.groupBy(F.col("cpe_name").alias("cpe")).agg(F.count("*").alias("rows"), F.first("id").alias("name_id"), F.first("deprecated").alias("deprecated"))
    checked = F.when(F.col("rows") > 1, F.raise_error(F.concat(F.lit("duplicate dictionary name: "), F.col("cpe"))).cast("bigint")).otherwise(F.col("name_id"))
    return grouped.select("cpe", checked.alias("name_id"), "deprecated")


def exact_match(components: DataFrame, names: DataFrame) -> DataFrame:
    """(cpe, name_id, deprecated, match_status) of every different name, by one left join on the raw string."""
    joined = distinct_names(components).join(dictionary_keys(names), "cpe", "left")
    return joined.withColumn("match_status", match_status(F.col("cpe"), F.col("deprecated")))


def component_matches(components: DataFrame, names: DataFrame) -> DataFrame:
    """Every component with the status of its name."""
    return components.join(exact_match(components, names).select("cpe", "name_id", "deprecated", "match_status"), "cpe", "left")


def with_dictionary_row(components: DataFrame, names: DataFrame, deprecated: bool) -> DataFrame:
    """Components whose name is official and (not) deprecated: a left semi join."""
    return components.join(names.filter(F.col("deprecated") == deprecated).select(F.col("cpe_name").alias("cpe")), "cpe", "left_semi")


def not_in_dictionary(components: DataFrame, names: DataFrame) -> DataFrame:
    """Components with a name that no dictionary row has: a left anti join."""
    return components.filter(present(F.col("cpe"))).join(names.select(F.col("cpe_name").alias("cpe")), "cpe", "left_anti")


def usage(components: DataFrame) -> DataFrame:
    """(cpe, component_count) of names that are present."""
    return components.filter(present(F.col("cpe"))).groupBy("cpe").agg(F.count("*").alias("component_count"))


def zero_filled(counts: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """counts with a row for every value of a closed list; missing numbers are 0."""
    wanted = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return wanted.join(counts, key, "left").na.fill(0, [c for c in counts.columns if c != key])


def match_counts(components: DataFrame, names: DataFrame) -> DataFrame:
    """(match_status, unique_cpes, components) for all four statuses.

    Blank names weigh in the components but are no unique name.
    """
    by_name = components.groupBy(F.coalesce("cpe", F.lit("")).alias("cpe")).agg(F.count("*").alias("n"))
    joined = by_name.join(dictionary_keys(names), "cpe", "left").withColumn("match_status", match_status(F.col("cpe"), F.col("deprecated")))
    counts = joined.groupBy("match_status").agg(F.count_if(F.col("cpe") != "").alias("unique_cpes"), F.sum("n").alias("components"))
    return zero_filled(counts, "match_status", MATCH_STATUSES)
