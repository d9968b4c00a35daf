"""Per-image, per-sbom and per-type overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.functions.cpe import present, safe_ratio


def image_overview(images: DataFrame, sboms: DataFrame, components: DataFrame) -> DataFrame:
    """Every image with numbers of sboms, components, named components and different names; 0 where there is none.

    Components are first summed per sbom and name, so the image join moves no component row. sboms hold an id once.
    """
    own = sboms.filter("docker_image_id is not null").select(F.col("id").alias("sbom_document_id"), "docker_image_id")
    held = own.groupBy("docker_image_id").agg(F.count("*").alias("sboms"))
    per = components.groupBy("sbom_document_id", F.coalesce("cpe", F.lit("")).alias("cpe")).agg(F.count("*").alias("n"))
    by_name = per.join(own, "sbom_document_id").groupBy("docker_image_id", "cpe").agg(F.sum("n").alias("n"))
    named = present(F.col("cpe"))
    counts = by_name.groupBy("docker_image_id").agg(F.sum("n").alias("components"), F.sum(F.when(named, F.col("n"))).alias("with_cpe"), F.count_if(named).alias("unique_cpes"))
    out = images.select(F.col("id").alias("docker_image_id"), "repository", "tag").join(held, "docker_image_id", "left").join(counts, "docker_image_id", "left")
    out = out.na.fill(0, ["sboms", "components", "with_cpe", "unique_cpes"]).withColumnRenamed("docker_image_id", "id")
    return out.withColumn("ratio", safe_ratio(F.col("with_cpe"), F.col("components")))


def sbom_overview(sboms: DataFrame, components: DataFrame) -> DataFrame:
    """Every sbom with its number of components."""
    per = components.groupBy("sbom_document_id").agg(F.count("*").alias("components"))
    return sboms.join(per, F.col("id") == F.col("sbom_document_id"), "left").drop("sbom_document_id").na.fill(0, ["components"])


def newest_first(sboms: DataFrame) -> DataFrame:
    return sboms.orderBy(F.desc_nulls_first("imported_at"), F.desc("id"))


def totals(overview: DataFrame) -> DataFrame:
    """Components and coverage over all images."""
    summed = overview.agg(F.sum("components").alias("components"), F.sum("with_cpe").alias("with_cpe"), F.count("*").alias("images"))
    return summed.withColumn("coverage", safe_ratio(F.col("with_cpe"), F.col("components")))


def type_usage(types: DataFrame, bridge: DataFrame) -> DataFrame:
    """Correction types with the number of different reviews that carry them."""
    per = bridge.groupBy("correction_type_id").agg(F.countDistinct("ground_truth_id").alias("usage_count"))
    return types.join(per, F.col("id") == F.col("correction_type_id"), "left").drop("correction_type_id").na.fill(0, ["usage_count"])


def sboms_of_images(images: DataFrame, sboms: DataFrame) -> DataFrame:
    """Every image with its sboms as an array of structs in order of id."""
    per = sboms.filter("docker_image_id is not null").groupBy("docker_image_id").agg(F.sort_array(F.collect_list(F.struct("id", "source_path"))).alias("documents"))
    joined = images.join(per, F.col("id") == F.col("docker_image_id"), "left").drop("docker_image_id")
    return joined.withColumn("documents", F.coalesce("documents", F.array().cast("array<struct<id:bigint,source_path:string>>")))


def result_counts(rows: DataFrame, succeeded) -> DataFrame:
    """(total, succeeded, failed, ratio) of rows by a condition."""
    counted = rows.agg(F.count("*").alias("total"), F.count_if(succeeded).alias("succeeded"), F.count_if(~succeeded).alias("failed"))
    return counted.withColumn("ratio", safe_ratio(F.col("succeeded"), F.col("total")))


def types_of_reviews(bridge: DataFrame) -> DataFrame:
    """(ground_truth_id, types): the names of each review's correction types, in order."""
    return bridge.groupBy("ground_truth_id").agg(F.sort_array(F.collect_set("name")).alias("types"))
