"""Inventory documents (CycloneDX JSON): loading, envelope rules, generators, and the recursive component tree.

Documents are parsed once into VARIANT, which keeps absent apart from null and numbers apart from text. A document that breaks
a rule carries the messages in `errors`; nothing fails until a caller asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlens.errors import EngineError
from bomlens.functions.text import content_path
from bomlens.operators.checks import duplicates, metadata_mismatches, missing_and_extra, require_empty
from bomlens.session import configure


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, raw, doc, file_sha256) of every file; doc is null where the text is no JSON."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_path"), "content")
    return from_bytes(files)


def from_bytes(files: DataFrame) -> DataFrame:
    """The same from (source_path, content) rows."""
    raw = F.decode("content", "UTF-8")
    return files.select("source_path", raw.alias("raw"), F.try_parse_json(raw).alias("doc"), F.sha2("content", 256).alias("file_sha256"))


def kind(doc: Column, path: str) -> Column:
    """The variant type at a path: STRING, BIGINT, VOID for null; null where the key is absent."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(doc, path, "variant")), r"^[A-Z]+", 0)


def required_text(doc: Column, path: str) -> Column:
    """The text at a path; null unless it is a string that is not blank."""
    text = F.try_variant_get(doc, path, "string")
    return F.when((kind(doc, path) == "STRING") & (F.trim(text) != ""), text)


def optional_text(doc: Column, path: str) -> Column:
    """The text at a path, '' where the key is absent or null; null for a value that is no text."""
    found = kind(doc, path)
    return F.when(found.isNull() | (found == "VOID"), "").when(found == "STRING", F.try_variant_get(doc, path, "string"))


def _tools(doc: Column) -> Column:
    """Tools of either layout: an object with components, or a list."""
    listed, nested = F.try_variant_get(doc, "$.metadata.tools", "array<variant>"), F.try_variant_get(doc, "$.metadata.tools.components", "array<variant>")
    return F.coalesce(nested, listed, F.array().cast("array<variant>"))


def _named(tool: Column, name: str) -> Column:
    return F.coalesce(F.lower(F.try_variant_get(tool, "$.name", "string")) == name, F.lit(False))


def strict_generator(doc: Column, name: str = "syft") -> Column:
    """struct(name, version) of the first tool of this name; null when it or its version is missing."""
    tool = F.get(F.filter(_tools(doc), lambda t: _named(t, name)), F.lit(0))
    return F.when(required_text(tool, "$.version").isNotNull(), F.struct(F.try_variant_get(tool, "$.name", "string").alias("name"), required_text(tool, "$.version").alias("version")))


def lenient_generator(doc: Column, preferred: str = "emba") -> Column:
    """struct(name, version) of the preferred tool, else of the first named one, else blanks."""
    named = F.filter(_tools(doc), lambda t: required_text(t, "$.name").isNotNull())
    tool = F.coalesce(F.get(F.filter(named, lambda t: _named(t, preferred)), F.lit(0)), F.get(named, F.lit(0)))
    version = F.when(kind(tool, "$.version") == "STRING", F.try_variant_get(tool, "$.version", "string"))
    return F.struct(F.coalesce(required_text(tool, "$.name"), F.lit("")).alias("name"), F.coalesce(version, F.lit("")).alias("version"))


def envelopes(documents: DataFrame, strict: bool = True) -> DataFrame:
    """documents with the envelope's columns and `errors`. Strict asks for the generator, components and an aware timestamp."""
    doc = F.col("doc")
    version_kind = kind(doc, "$.version")
    number = F.try_variant_get(doc, "$.version", "int")
    stamp = F.try_variant_get(doc, "$.metadata.timestamp", "string")
    aware = stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})\z")
    parts = kind(doc, "$.components")
    is_array = F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(doc, "$.components", "variant")), F.lit("ARRAY")), F.lit(False))
    rules = [
        (doc.isNull() | ~F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), "no JSON object"),
        (~F.coalesce(F.try_variant_get(doc, "$.bomFormat", "string") == "CycloneDX", F.lit(False)), "bomFormat"),
        (required_text(doc, "$.specVersion").isNull(), "specVersion"),
        (version_kind.isNotNull() & ~((version_kind == "BIGINT") & (number >= 1)), "version"),
        (stamp.isNotNull() & ~(aware & F.try_to_timestamp(stamp).isNotNull()), "timestamp"),
        (~is_array if strict else parts.isNotNull() & ~is_array, "components"),
    ]
    generator = strict_generator(doc) if strict else lenient_generator(doc)
    if strict:
        rules.append((generator.isNull(), "generator"))
    errors = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for test, name in rules]))
    return documents.select(
        "*",
        F.try_variant_get(doc, "$.specVersion", "string").alias("spec_version"),
        F.coalesce(optional_text(doc, "$.serialNumber"), F.lit("")).alias("serial_number"),
        F.coalesce(number, F.lit(1)).alias("document_version"),
        F.when(aware, F.try_to_timestamp(stamp)).alias("generated_at"),
        generator.alias("generator"),
        errors.alias("errors"),
    )


def components(documents: DataFrame) -> DataFrame:
    """A row per component at any depth, in pre-order by `place`: bom_ref, type, name and the optional texts; `ok` marks the rule-abiding."""
    spark = configure(documents.sparkSession)
    tree = spark.sql("""
        WITH RECURSIVE tree AS (
          SELECT d.source_path, v.value AS node, array(v.pos) AS place FROM {documents} d, LATERAL variant_explode(try_variant_get(d.doc, '$.components', 'variant')) v
          UNION ALL
          SELECT t.source_path, v.value, array_append(t.place, v.pos) FROM tree t, LATERAL variant_explode(try_variant_get(t.node, '$.components', 'variant')) v)
        SELECT source_path, node, place FROM tree""", documents=documents.select("source_path", "doc"))
    node = F.col("node")
    texts = {name: F.coalesce(optional_text(node, f"$.{name}"), F.lit("")) for name in ("version", "group", "publisher", "purl", "cpe")}
    required = {"bom_ref": required_text(node, "$['bom-ref']"), "component_type": required_text(node, "$.type"), "name": required_text(node, "$.name")}
    ok = required["bom_ref"].isNotNull() & required["component_type"].isNotNull() & required["name"].isNotNull()
    properties = F.coalesce(F.try_variant_get(node, "$.properties", "array<struct<name:string,value:string>>"), F.array().cast("array<struct<name:string,value:string>>"))
    return tree.select("source_path", "place", *[c.alias(n) for n, c in {**required, **texts}.items()], properties.alias("properties"), ok.alias("ok"))


def file_tallies(documents: DataFrame) -> DataFrame:
    """(source_path, components, with_cpe) of every document, also of those without components."""
    counts = components(documents).groupBy("source_path").agg(F.count("*").alias("components"), F.count_if(F.col("cpe") != "").alias("with_cpe"))
    return documents.select("source_path").join(counts, "source_path", "left").na.fill(0, ["components", "with_cpe"])


def new_images(records: DataFrame, images: DataFrame) -> DataFrame:
    """The image records whose digest is not there yet; other metadata under a known digest, or a known pinned reference under another, is fatal."""
    fields = ["repository", "tag", "platform", "pinned_reference"]
    known = images.select(F.col("manifest_digest").alias("known_digest"), "pinned_reference")
    collisions = records.join(known, "pinned_reference").filter(F.col("known_digest") != F.col("manifest_digest")).select("pinned_reference")
    require_empty({"image metadata": metadata_mismatches(images, records, "manifest_digest", fields), "pinned reference": collisions})
    return records.join(images.select("manifest_digest"), "manifest_digest", "left_anti")


def import_documents(documents: DataFrame, records: DataFrame, images: DataFrame, sboms: DataFrame, dry_run: bool = False) -> dict[str, DataFrame]:
    """A whole set of documents as frames: images, sboms and components to append, tallies per file, and totals.

    documents are read_documents with manifest_digest; each belongs to one record. Nothing is given unless everything keeps
    the rules; a document whose bytes are there already is skipped if its metadata is the same, else it is fatal. A dry run gives
    the tallies alone.
    """
    enveloped = envelopes(documents)
    own = enveloped.select("file_sha256", "source_path", "spec_version", F.col("generator.name").alias("generator_name"), F.col("generator.version").alias("generator_version"), "manifest_digest")
    fields = ["source_path", "spec_version", "generator_name", "generator_version", "manifest_digest"]
    found = components(documents)
    require_empty(
        {
            "envelope": enveloped.filter(F.size("errors") > 0).select("source_path", "errors"),
            "component": found.filter(~F.col("ok")).select("source_path", "place"),
            "repeated bom-ref": repeated_refs(found),
            "image without document": missing_and_extra(records.select("manifest_digest"), documents.select("manifest_digest"), "manifest_digest"),
            "document metadata": metadata_mismatches(sboms, own, "file_sha256", fields),
        }
    )
    created = new_images(records, images)
    fresh = own.join(sboms.select("file_sha256"), "file_sha256", "left_anti")
    skipped = own.join(sboms.select("file_sha256"), "file_sha256", "left_semi").select("source_path", F.lit("skipped").alias("status"))
    status = fresh.select("source_path", F.lit("created").alias("status")).unionByName(skipped)
    tallies = file_tallies(documents).join(status, "source_path")
    done = F.col("status") == "created"
    totals = tallies.agg(F.count("*").alias("files"), F.count_if(done).alias("created"), F.count_if(~done).alias("skipped"), F.sum(F.when(done, F.col("components")).otherwise(0)).alias("components_created"), F.sum("with_cpe").alias("with_cpe"))
    out = {"files": tallies, "totals": totals}
    return out if dry_run else out | {"images": created, "sboms": fresh, "components": found.join(fresh.select("source_path", "file_sha256"), "source_path")}


def repeated_refs(found: DataFrame) -> DataFrame:
    """bom-refs that stand more than once in a document."""
    return duplicates(found, "source_path", "bom_ref")


def new_uploads(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """Valid uploads whose bytes are not there yet, one per hash, with the path they are stored at."""
    fresh = uploads.filter(F.size("errors") == 0).join(existing.select("file_sha256"), "file_sha256", "left_anti").dropDuplicates(["file_sha256"])
    return fresh.withColumn("uploaded_file", content_path(F.col("file_sha256"))).withColumn("source_type", F.lit("upload")).withColumn("scope", F.lit("document"))


def duplicate_uploads(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploads whose bytes are there already, with the id of the existing document."""
    return uploads.join(existing.select("file_sha256", F.col("id").alias("existing_id")), "file_sha256")


def delete_document(sboms: DataFrame, found: DataFrame, reviews: DataFrame, sbom_id: int) -> tuple[DataFrame, DataFrame]:
    """sboms and components without a document; refused while a review refers to one of its components."""
    own = found.filter(F.col("sbom_document_id") == sbom_id).select(F.col("id").alias("component_id"))
    if reviews.join(own, "component_id", "left_semi").limit(1).count():
        raise EngineError("sbom_has_reviews")
    return sboms.filter(F.col("id") != sbom_id), found.filter(F.col("sbom_document_id") != sbom_id)
