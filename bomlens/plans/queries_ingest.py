"""Ingest operators over documents that are built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bomlens.plans.registry import query
from bomlens.sources import dictionary, images, sbom


def _documents(d):
    """A document per conversation: every turn is a component inside that of the turn before. Tools, and what is wrong, differ."""
    node = F.struct(F.col("turn"), F.concat(F.lit("ref-"), F.col("turn").cast("string")).alias("ref"), F.col("role"))
    per = d.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(node)).alias("turns"))

    def around(inner, t):
        return F.concat(F.lit('{"bom-ref":"'), t["ref"], F.lit('","type":"library","name":"'), t["role"], F.lit('","components":['), inner, F.lit("]}"))

    conv, minor = F.col("conv_id"), (F.col("conv_id") % 5).cast("string")
    tools = (
        F.when(conv % 4 == 0, F.concat(F.lit('[{"name":"syft","version":"1.'), minor, F.lit('"}]')))
        .when(conv % 4 == 1, F.concat(F.lit('{"components":[{"name":"other","version":"9"},{"name":"Syft","version":"2.'), minor, F.lit('"}]}')))
        .when(conv % 4 == 2, F.lit('[{"name":"other"},{"name":"EMBA","version":"3"}]'))
        .otherwise(F.lit('[{"name":"other","version":""},{"name":"syft"}]'))
    )
    text = F.concat(
        F.lit('{"bomFormat":"CycloneDX",'), F.when(conv % 5 == 0, "").otherwise('"specVersion":"1.6",'), F.lit('"version":'), F.when(conv % 7 == 0, "0").otherwise("1"),
        F.lit(',"metadata":{"timestamp":"2024-01-01T00:00:00Z","tools":'), tools, F.lit('},"components":['), F.aggregate(F.reverse("turns"), F.lit(""), around), F.lit("]}"),
    )
    return sbom.from_bytes(per.select(F.concat(F.lit("conv-"), conv.cast("string")).alias("source_path"), text.cast("binary").alias("content")))


_CONVERSATIONS = "(select conv_id, conv_id % 4 r, '' || (conv_id % 5) k from conversations group by 1)"


@query("A23_component_tree", "select 'conv-' || conv_id source_path, 'ref-' || turn bom_ref, role as name, row_number() over (partition by conv_id order by turn) depth from conversations")
def _(d):
    return sbom.components(_documents(d)).select("source_path", "bom_ref", "name", F.size("place").cast("bigint").alias("depth"))


@query("A24_envelopes", f"select 'conv-' || conv_id source_path, case when conv_id % 5 > 0 then '1.6' end spec_version, (r >= 2)::int + (conv_id % 5 = 0)::int + (conv_id % 7 = 0)::int n_errors from {_CONVERSATIONS}")
def _(d):
    return sbom.envelopes(_documents(d)).select("source_path", "spec_version", F.size("errors").alias("n_errors"))


@query("A21_strict_generator", f"select 'conv-' || conv_id source_path, case r when 0 then 'syft' when 1 then 'Syft' end as name, case r when 0 then '1.' || k when 1 then '2.' || k end as version from {_CONVERSATIONS}")
def _(d):
    return _documents(d).select("source_path", sbom.strict_generator(F.col("doc")).alias("g")).select("source_path", "g.name", "g.version")


@query("A22_lenient_generator", f"select 'conv-' || conv_id source_path, case r when 0 then 'syft' when 2 then 'EMBA' else 'other' end as name, case r when 0 then '1.' || k when 1 then '9' when 2 then '3' else '' end as version from {_CONVERSATIONS}")
def _(d):
    return _documents(d).select("source_path", sbom.lenient_generator(F.col("doc")).alias("g")).select("source_path", "g.name", "g.version")


@query("A28_import_tallies", "select 'conv-' || conv_id source_path, count(*) components, 0 with_cpe from conversations group by conv_id")
def _(d):
    return sbom.file_tallies(_documents(d))


def _products(d):
    names = d.names()
    text = F.concat(
        F.lit('{"cpe":{"cpeName":"'), F.replace(F.col("cpe_name"), F.lit("\\"), F.lit("\\\\")), F.lit('","cpeNameId":"'), F.lpad(F.hex("id"), 32, "0"), F.lit('","deprecated":'), F.col("deprecated").cast("string"),
        F.lit(',"created":"2024-01-01T00:00:00.000","lastModified":"2024-01-02T00:00:00-04:00","titles":[{"title":"T'), F.col("id").cast("string"), F.lit('","lang":"en"}],"refs":[{"ref":"r'), F.col("id").cast("string"), F.lit('"}]}}'),
    )
    return names.select(F.lit(1).alias("sequence"), F.parse_json(text).alias("product"))


@query("A13_records", "select p_partkey id, lpad(lower(to_hex(p_partkey)), 32, '0') bare_id, p_partkey % 10 = 0 deprecated, timestamp '2024-01-01' created, timestamp '2024-01-02 04:00:00' modified, 0 n_errors from part")
def _(d):
    found = dictionary.records(_products(d))
    number = F.conv(F.replace("cpe_name_id", F.lit("-"), F.lit("")), 16, 10).cast("bigint")
    return found.select(number.alias("id"), F.replace("cpe_name_id", F.lit("-"), F.lit("")).alias("bare_id"), "deprecated", F.col("created_at_nvd").alias("created"), F.col("last_modified_at_nvd").alias("modified"), F.size("errors").alias("n_errors"))


@query("B13_titles", "select p_partkey id, 'T' || p_partkey title from part")
def _(d):
    found = dictionary.records(_products(d))
    number = F.conv(F.replace("cpe_name_id", F.lit("-"), F.lit("")), 16, 10).cast("bigint")
    return found.select(number.alias("id"), dictionary.representative_title(F.col("titles")).alias("title"))


@query("B14_references", "select p_partkey id, 'r' || p_partkey url from part")
def _(d):
    found = dictionary.records(_products(d))
    number = F.conv(F.replace("cpe_name_id", F.lit("-"), F.lit("")), 16, 10).cast("bigint")
    return found.select(number.alias("id"), F.get(dictionary.normal_references(F.col("references")), F.lit(0))["url"].alias("url"))


@query("A33_platform_manifest", "select 'n-' || n_nationkey source_path, case when n_nationkey % 3 = 0 then null else 'sha256:' || n_nationkey end digest, case when n_nationkey % 3 = 0 then 0 else 1 end matches from nation")
def _(d):
    key = F.col("n_nationkey").cast("string")
    arch = F.when(F.col("n_nationkey") % 3 == 0, "arm64").otherwise("amd64")
    content = F.concat(F.lit('{"manifests":[{"digest":"sha256:'), key, F.lit('","platform":{"os":"linux","architecture":"'), arch, F.lit('"}},{"digest":"x","platform":{"os":"unknown","architecture":"unknown"}}]}'))
    indexes = d.table("nation").select(F.concat(F.lit("n-"), key).alias("source_path"), content.alias("content"))
    return images.platform_manifest(indexes).select("source_path", "digest", "matches")


@query("A19_digest_records", "select 'docker.io/library/' || lower(n_name) repository, 'docker.io/library/' || lower(n_name) || '@sha256:' || sha256(n_name) pinned_reference, regexp_replace(lower(n_name), '[^A-Za-z0-9._-]+', '_', 'g') || '-1.0.cdx.json' filename from nation where n_nationkey % 4 > 0")
def _(d):
    repository, digest = F.concat(F.lit("docker.io/library/"), F.lower("n_name")), F.concat(F.lit("sha256:"), F.sha2("n_name", 256))
    row = F.struct(
        F.when(F.col("n_nationkey") % 4 > 0, "success").otherwise("failed").alias("status"), repository.alias("normalized_repository"), F.lit("1.0").alias("input_tag"),
        digest.alias("platform_manifest_digest"), F.concat(repository, F.lit("@"), digest).alias("pinned_reference"),
    )
    text = d.table("nation").agg(F.to_json(F.struct(F.struct(F.lit("linux").alias("os"), F.lit("amd64").alias("architecture")).alias("platform"), F.collect_list(row).alias("images"))).alias("content"))
    return images.digest_records(text).select("repository", "pinned_reference", "filename")


@query("A39_row_template", "select n_nationkey, case when n_nationkey % 3 = 0 then 'failed' else 'success' end status, case when n_nationkey % 3 = 0 then 'PlatformError' end error_type, case when n_nationkey % 3 = 0 then 'platform ' || n_nationkey end error_message from nation")
def _(d):
    row = images.result_row(F.col("n_nationkey") % 3 != 0, F.lit("PlatformError"), F.concat(F.lit("platform "), F.col("n_nationkey").cast("string")))
    return d.table("nation").select("n_nationkey", row.alias("row")).select("n_nationkey", "row.*")
