"""Image digests and manifest indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.errors import EngineError
from bomlens.functions.text import DIGEST, sbom_filename
from bomlens.operators.checks import duplicates, require_empty

IMAGE = "array<struct<status:string,normalized_repository:string,input_tag:string,platform_manifest_digest:string,pinned_reference:string>>"


def digest_records(texts: DataFrame, expected: int | None = None) -> DataFrame:
    """Successful images of digest files (content): repository, tag, digest, pinned reference, expected file name; checked."""
    doc = F.from_json("content", f"platform struct<os:string,architecture:string>, images {IMAGE}")
    rows = texts.select(doc.alias("doc")).select("doc.platform", F.explode("doc.images").alias("image")).filter("image.status = 'success'")
    found = rows.select(
        F.col("image.normalized_repository").alias("repository"), F.col("image.input_tag").alias("tag"), F.concat_ws("/", "platform.os", "platform.architecture").alias("platform"),
        F.col("image.platform_manifest_digest").alias("manifest_digest"), F.col("image.pinned_reference").alias("pinned_reference"),
    ).withColumn("filename", sbom_filename(F.col("repository"), F.col("tag")))
    wrong = found.filter(~F.coalesce(F.col("manifest_digest").rlike(DIGEST) & (F.col("pinned_reference") == F.concat("repository", F.lit("@"), "manifest_digest")), F.lit(False)))
    require_empty({"digest": wrong} | {f"repeated {key}": duplicates(found, key) for key in ("manifest_digest", "pinned_reference", "filename")})
    if expected is not None and found.count() != expected:
        raise EngineError("image_count")
    return found


def result_row(status, error_type=None, message=None):
    """struct(status, error_type, error_message) of a result; one that did not succeed stays failed, with its error told."""
    error = [F.lit(None).cast("string") if x is None else x for x in (error_type, message)]
    done = F.coalesce(status, F.lit(False))
    return F.struct(F.when(done, "success").otherwise("failed").alias("status"), F.when(~done, error[0]).alias("error_type"), F.when(~done, error[1]).alias("error_message"))


def platform_manifest(indexes: DataFrame, os_name: str = "linux", architecture: str = "amd64") -> DataFrame:
    """(source_path, digest, matches, error): the one descriptor of a platform in each index (source_path, content)."""
    doc = F.from_json("content", "mediaType string, manifests array<struct<digest:string,mediaType:string,platform:struct<os:string,architecture:string>>>")
    rows = indexes.select("source_path", doc.alias("doc"))
    fits = F.filter("doc.manifests", lambda m: (m["platform"]["os"] == os_name) & (m["platform"]["architecture"] == architecture))
    out = rows.select("source_path", F.coalesce(fits, F.array().cast("array<struct<digest:string,mediaType:string,platform:struct<os:string,architecture:string>>>")).alias("fits"))
    one = F.size("fits") == 1
    return out.select("source_path", F.when(one, F.get("fits", F.lit(0))["digest"]).alias("digest"), F.size("fits").alias("matches"), F.when(~one, F.lit("platform_not_unique")).alias("error"))
