"""Weaker structured matches of names that the dictionary does not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlens.functions.cpe import VALID, parse
from bomlens.operators.matching import not_in_dictionary, usage, zero_filled

FOUR, THREE, TWO, NONE, UNPARSABLE = "SAME_PART_VENDOR_PRODUCT_VERSION", "SAME_PART_VENDOR_PRODUCT", "SAME_PART_PRODUCT", "NO_STRUCTURED_MATCH", "UNPARSABLE"
PROFILES = (FOUR, THREE, TWO, NONE, UNPARSABLE)
KEYS = {"four": ("part", "vendor", "product", "version"), "three": ("part", "vendor", "product"), "two": ("part", "product")}
MEASURES = ("total", "active", "deprecated")
UNPARSED_PART = "<unparsable>"


def profile_of(status: Column, four: Column, three: Column, two: Column) -> Column:
    """The strongest level with a dictionary row."""
    return F.when(status != VALID, UNPARSABLE).when(four > 0, FOUR).when(three > 0, THREE).when(two > 0, TWO).otherwise(NONE)


def population(components: DataFrame, names: DataFrame) -> DataFrame:
    """Unmatched names with their number of components, parsed."""
    return parse(not_in_dictionary(usage(components), names)).drop("fields")


def keys_of_interest(parsed: DataFrame, level: str) -> DataFrame:
    return parsed.filter(F.col("status") == VALID).select(*KEYS[level]).distinct()


def relevant_names(names: DataFrame, parsed: DataFrame) -> DataFrame:
    """Dictionary rows whose part and product some parsed name has: a semi join instead of a long disjunction."""
    return names.join(keys_of_interest(parsed, "two"), ["part", "product"], "left_semi")


def grouped_names(names: DataFrame) -> DataFrame:
    """Total, active and deprecated rows by part, vendor, product, version, in one scan."""
    return names.groupBy(*KEYS["four"]).agg(F.count("*").alias("total"), F.count_if(~F.col("deprecated")).alias("active"), F.count_if("deprecated").alias("deprecated"))


def rolled_up(grouped: DataFrame, level: str) -> DataFrame:
    """Sums of grouped_names at a coarser level; the scan is not repeated and no row is tripled."""
    if level == "four":
        return grouped
    return grouped.groupBy(*KEYS[level]).agg(*[F.sum(m).alias(m) for m in MEASURES])


def _key(level: str) -> Column:
    """The key of a level as a struct of level and four fields; fields beyond the level are ''."""
    return F.struct(F.lit(level).alias("level"), *[(F.col(f) if f in KEYS[level] else F.lit("")).alias(f) for f in KEYS["four"]])


def level_counts(grouped: DataFrame) -> DataFrame:
    """(key, total, active, deprecated) of grouped_names at all three levels, from one pass over the grouped rows."""
    keyed = grouped.select(F.explode(F.array(*[_key(level) for level in KEYS])).alias("key"), *MEASURES)
    return keyed.groupBy("key").agg(*[F.sum(m).alias(m) for m in MEASURES])


def mismatches(components: DataFrame, names: DataFrame) -> DataFrame:
    """A row per unmatched name: attributes, component_count, counts of the three levels, and its profile.

    Valid names look up their three keys in one join; the components are read once, the dictionary once for the exact match
    and once for the counts.
    """
    population_ = population(components, names).select("cpe", "status", *KEYS["four"], "component_count")
    keys = F.when(F.col("status") == VALID, F.array(*[_key(level) for level in KEYS]))
    looked = population_.withColumn("key", F.explode_outer(keys)).join(level_counts(grouped_names(names)), "key", "left")
    counts = {f"{level}_{m}": F.coalesce(F.sum(F.when(F.col("key.level") == level, F.col(m))), F.lit(0)).alias(f"{level}_{m}") for level in KEYS for m in MEASURES}
    out = looked.groupBy("cpe").agg(*[F.first(c).alias(c) for c in ("status", *KEYS["four"], "component_count")], *counts.values())
    return out.withColumn("profile", profile_of(F.col("status"), F.col("four_total"), F.col("three_total"), F.col("two_total"))).select(
        "cpe", "status", *KEYS["four"], "component_count", *counts, "profile"
    )


def report_order(found: DataFrame) -> DataFrame:
    return found.orderBy("profile", F.desc("component_count"), "cpe")


def profile_counts(found: DataFrame) -> DataFrame:
    """(profile, unique_cpes, components) for all five profiles."""
    counts = found.groupBy("profile").agg(F.count("*").alias("unique_cpes"), F.sum("component_count").alias("components"))
    return zero_filled(counts, "profile", PROFILES)


def field_histogram(found: DataFrame) -> DataFrame:
    """(field, value, unique_cpes, components) of the attributes of valid names."""
    long = found.filter(F.col("status") == VALID).unpivot(["cpe", "component_count"], list(KEYS["four"]), "field", "value")
    return long.groupBy("field", "value").agg(F.count("*").alias("unique_cpes"), F.sum("component_count").alias("components"))


def profile_by_part(found: DataFrame) -> DataFrame:
    """A row per part, a column per profile; names that do not parse form a part of their own."""
    part = F.when(F.col("status") == VALID, F.col("part")).otherwise(UNPARSED_PART)
    return found.groupBy(part.alias("part")).pivot("profile", list(PROFILES)).count().na.fill(0)


def key_counts(found: DataFrame) -> DataFrame:
    """Distinct keys at the three levels, over valid names."""
    valid = found.filter(F.col("status") == VALID)
    return valid.agg(*[F.countDistinct(*keys).alias(f"{level}_keys") for level, keys in KEYS.items()])
