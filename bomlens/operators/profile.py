"""Coverage and usage profile of component names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.functions.cpe import FIELDS, PARTS, STATUSES, VALID, VERSION_KINDS, joined_distinct, parsed, present, safe_ratio, version_kind
from bomlens.operators.matching import zero_filled


def image_coverage(located: DataFrame) -> DataFrame:
    """(docker_image_id, total, with_cpe) of images with components."""
    return located.filter("docker_image_id is not null").groupBy("docker_image_id").agg(F.count("*").alias("total"), F.count_if(present(F.col("cpe"))).alias("with_cpe"))


def parsed_components(components: DataFrame) -> DataFrame:
    """Components with a name, and its attributes; the name's version is cpe_version. No shuffle: a name is parsed where it stands."""
    named, found = components.filter(present(F.col("cpe"))).withColumn("_parsed", parsed(F.col("cpe"))), F.col("_parsed")
    return named.withColumns({"status": found["status"]} | {"cpe_version" if f == "version" else f: found[f] for f in FIELDS}).drop("_parsed")


def _counts(parsed: DataFrame, *keys) -> DataFrame:
    return parsed.groupBy(*keys).agg(F.count("*").alias("components"), F.countDistinct("cpe").alias("unique_cpes"))


def status_counts(parsed: DataFrame) -> DataFrame:
    return zero_filled(_counts(parsed, "status"), "status", STATUSES)


def part_counts(parsed: DataFrame) -> DataFrame:
    return zero_filled(_counts(parsed.filter(F.col("status") == VALID), "part"), "part", PARTS)


def version_counts(parsed: DataFrame) -> DataFrame:
    valid = parsed.filter(F.col("status") == VALID)
    return zero_filled(_counts(valid, version_kind(F.col("cpe_version")).alias("version_kind")), "version_kind", VERSION_KINDS)


def vendor_counts(parsed: DataFrame) -> DataFrame:
    return _counts(parsed.filter(F.col("status") == VALID), "vendor")


def vendor_products(parsed: DataFrame) -> DataFrame:
    """Components, names and images by part, vendor and product; rows of equal name and image are added up first."""
    valid = parsed.filter(F.col("status") == VALID).groupBy("part", "vendor", "product", "cpe", "docker_image_id").agg(F.count("*").alias("n"))
    return valid.groupBy("part", "vendor", "product").agg(F.sum("n").alias("components"), F.countDistinct("cpe").alias("unique_cpes"), F.countDistinct("docker_image_id").alias("images"))


def cpe_usage(parsed: DataFrame) -> DataFrame:
    """A row per name: numbers of components, images, sboms and component names, and the joined repositories and names.

    Images and names are counted from the sets that the report lists anyway, so rows are not multiplied.
    """
    return parsed.groupBy("cpe", "status").agg(
        F.count("*").alias("components"),
        F.size(F.collect_set("docker_image_id")).cast("bigint").alias("images"),
        F.countDistinct("sbom_document_id").alias("sboms"),
        F.size(F.collect_set("name")).cast("bigint").alias("names"),
        joined_distinct(F.col("repository")).alias("repositories"),
        joined_distinct(F.col("name")).alias("component_names"),
    )


def invalid_usage(usage: DataFrame) -> DataFrame:
    return usage.filter(F.col("status") != VALID)


def name_counts(located: DataFrame) -> DataFrame:
    """(docker_image_id, cpe, n): components by image and name, of which the summaries are made."""
    return located.groupBy("docker_image_id", F.coalesce("cpe", F.lit("")).alias("cpe")).agg(F.count("*").alias("n"))


def image_summary(images: DataFrame, counts: DataFrame) -> DataFrame:
    """Every image, with its coverage, valid and invalid components and different names; images without components have 0."""
    named = present(F.col("cpe"))
    judged = counts.filter("docker_image_id is not null").withColumn("valid", parsed(F.col("cpe"))["status"] == VALID)
    per = judged.groupBy("docker_image_id").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(named, F.col("n"))).alias("with_cpe"),
        F.sum(F.when(named & F.col("valid"), F.col("n"))).alias("valid"),
        F.sum(F.when(named & ~F.col("valid"), F.col("n"))).alias("invalid"),
        F.count_if(named).alias("unique_cpes"),
    )
    joined = images.join(per, F.col("id") == F.col("docker_image_id"), "left").na.fill(0, ["total", "with_cpe", "valid", "invalid", "unique_cpes"])
    return joined.select("id", "repository", "tag", "total", "with_cpe", safe_ratio(F.col("with_cpe"), F.col("total")).alias("ratio"), "valid", "invalid", "unique_cpes")


def profile_summary(images: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: total_components sums image rows only, all_components counts every component. counts is name_counts."""
    totals = image_summary(images, counts).agg(F.sum("total").alias("total_components"), F.sum("with_cpe").alias("components_with_cpe"), F.count("*").alias("images"))
    uses = counts.groupBy("cpe").agg(F.sum("n").alias("n"))
    named = present(F.col("cpe"))
    reuse = uses.agg(F.count_if(named).alias("unique_cpes"), F.count_if(named & (F.col("n") > 1)).alias("reused_primary_cpes"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_components"))
    joined = totals.withColumn("one", F.lit(1)).join(reuse.withColumn("one", F.lit(1)), "one").drop("one")
    return joined.withColumn("ratio", safe_ratio(F.col("components_with_cpe"), F.col("total_components")))
