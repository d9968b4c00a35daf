"""Scalar functions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from bomlens.functions import cpe as C
from bomlens.functions import text as T
from bomlens.operators import matching, review
from bomlens.plans.domain import over_domain
from bomlens.plans.registry import query


def _parsed(d):
    return C.parse(matching.distinct_names(d.components()))


@query("B01_parse_status", over_domain("select cpe, status from parsed"))
def _(d):
    return _parsed(d).select("cpe", "status")


@query("B02_parse_message", over_domain("""select cpe, case status when 'INVALID_PREFIX' then 'name must start with cpe:2.3:' when 'INVALID_ESCAPE' then 'name ends in a dangling escape' when 'INVALID_FIELD_COUNT' then 'expected 11 fields, found ' || len(f)
 when 'INVALID_PART' then 'part must be a, o or h, found ''' || f[1] || '''' else '' end message from parsed"""))
def _(d):
    return _parsed(d).select("cpe", C.message(F.col("status"), F.col("fields")).alias("message"))


@query("B03_attributes", over_domain("select cpe, " + ", ".join(f"case when status = 'STRUCTURALLY_VALID' then f[{k + 1}] else '' end \"{f}\"" for k, f in enumerate(C.FIELDS)) + " from parsed"))
def _(d):
    return _parsed(d).select("cpe", *C.FIELDS)


@query("B04_version_kind", over_domain("select cpe, case version when '*' then 'wildcard' when '-' then 'NA' else 'explicit' end version_kind from attrs where status = 'STRUCTURALLY_VALID'"))
def _(d):
    return _parsed(d).filter(F.col("status") == C.VALID).select("cpe", C.version_kind(F.col("version")).alias("version_kind"))


@query("B17_fields_or_null", over_domain("select cpe, case when status = 'STRUCTURALLY_VALID' then vendor end vendor, case when status = 'STRUCTURALLY_VALID' then product end product, case when status = 'STRUCTURALLY_VALID' then null else status end error from attrs"))
def _(d):
    fields = C.structural_fields(F.col("status"), "vendor", "product")
    return _parsed(d).withColumn("fields", fields).select("cpe", "fields.vendor", "fields.product", F.nullif(F.col("status"), F.lit(C.VALID)).alias("error"))


@query("B18_image_reference", over_domain("select id, case when repository is not null then repository || ':' || tag end image_reference from located"))
def _(d):
    return d.located().select("id", F.concat("repository", F.lit(":"), "tag").alias("image_reference"))


@query("B19_basename", over_domain("select id, string_split(repository, '/')[-1] basename from images"))
def _(d):
    return d.images().select("id", T.basename(F.col("repository")).alias("basename"))


@query("B20_upload_basename", "select page_id, string_split(replace(url, '\\', '/'), '/')[-1] basename from pages")
def _(d):
    return d.table("pages").select("page_id", T.upload_basename(F.col("url")).alias("basename"))


@query("B09_hangul", "select doc_id, regexp_matches(text, '[\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{A960}-\\x{A97F}\\x{AC00}-\\x{D7FF}\\x{FFA0}-\\x{FFDC}]') hangul from documents")
def _(d):
    return d.table("documents").select("doc_id", T.has_hangul(F.col("text")).alias("hangul"))


@query("B10_normal_code", "select s_suppkey, lower(trim(replace(s_name, '#', '_'))) code, regexp_full_match(lower(trim(replace(s_name, '#', '_'))), '[a-z][a-z0-9_]*') as valid from supplier")
def _(d):
    name = F.replace(F.col("s_name"), F.lit("#"), F.lit("_"))
    return d.table("supplier").select("s_suppkey", T.normal_code(name).alias("code"), T.is_code(name).alias("valid"))


@query("B11_digest_patterns", "select doc_id, regexp_full_match(sha256(text), '[0-9a-f]{64}') sha, regexp_full_match('sha256:' || upper(sha256(text)), 'sha256:[0-9a-f]{64}') upper_digest from documents")
def _(d):
    sha = F.sha2(F.col("text"), 256)
    return d.table("documents").select("doc_id", sha.rlike(T.SHA256).alias("sha"), F.concat(F.lit("sha256:"), F.upper(sha)).rlike(T.DIGEST).alias("upper_digest"))


@query("A07_text_sha256", "select doc_id, sha256(text) sha from documents")
def _(d):
    return d.table("documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha"))


@query("A30_content_path", "select doc_id, 'sboms/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.json' path from documents")
def _(d):
    return d.table("documents").select("doc_id", T.content_path(F.sha2(F.col("text"), 256)).alias("path"))


@query("A02_snapshot_id", "select o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') snapshot_id from orders")
def _(d):
    return d.table("orders").select("o_orderkey", T.snapshot_id(F.col("o_orderdate")).alias("snapshot_id"))


@query("B23_render_utc", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || strftime(ts, '%g') || 'Z' rendered from events")
def _(d):
    return d.table("events").select("event_id", T.render_utc(F.col("ts")).alias("rendered"))


@query("B22_timestamps", "select o_orderkey, o_orderdate naive, o_orderdate - interval 2 hour shifted, o_orderkey % 2 = 0 strict_ok from orders")
def _(d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    offset = F.concat(text, F.lit("+02:00"))
    strict = F.when(F.col("o_orderkey") % 2 == 0, offset).otherwise(text)
    return d.table("orders").select("o_orderkey", T.utc_timestamp(text).alias("naive"), T.utc_timestamp(offset).alias("shifted"), T.aware_timestamp(strict).isNotNull().alias("strict_ok"))


_REF = "case o % 4 when 0 then lower(c_mktsegment) when 1 then lower(c_mktsegment) || ':1.' || o when 2 then 'ghcr.io/org/' || lower(c_mktsegment) || ':v' || o else 'index.docker.io/' || lower(c_mktsegment) end"


@query("A32_image_reference", f"""with r as (select c_custkey, {_REF} ref, o from (select *, c_custkey o from customer)),
 p as (select *, case when o % 4 = 2 then 'ghcr.io' else 'docker.io' end registry from r)
select c_custkey, registry, registry || '/' || case when o % 4 = 2 then 'org/' else 'library/' end || lower(c_mktsegment) repository, case o % 4 when 1 then '1.' || o when 2 then 'v' || o else 'latest' end tag from p join customer using (c_custkey)""")
def _(d):
    key, segment = F.col("c_custkey").cast("string"), F.lower("c_mktsegment")
    case = F.col("c_custkey") % 4
    ref = F.when(case == 0, segment).when(case == 1, F.concat(segment, F.lit(":1."), key)).when(case == 2, F.concat(F.lit("ghcr.io/org/"), segment, F.lit(":v"), key)).otherwise(F.concat(F.lit("index.docker.io/"), segment))
    return d.table("customer").select("c_custkey", T.image_reference(ref).alias("r")).select("c_custkey", "r.registry", "r.repository", "r.tag")


@query("A38_safe_filename", "select page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') safe, regexp_full_match(url, '[A-Za-z0-9._-]+') already from pages")
def _(d):
    return d.table("pages").select("page_id", T.safe_filename(F.col("url")).alias("safe"), T.is_safe_filename(F.col("url")).alias("already"))


@query("B12_display_identity", "select c_custkey, case c_custkey % 4 when 0 then c_name || ' ' || c_mktsegment when 1 then c_mktsegment || ':latest - syft 1.0' when 2 then c_name || '.json' else 'SBOM ' || substr(sha256(c_name), 1, 12) end shown from customer")
def _(d):
    case = F.col("c_custkey") % 4
    blank = F.lit("")
    shown = T.display_identity(
        F.when(case == 0, F.col("c_name")).otherwise(blank), blank, F.when(case == 0, F.col("c_mktsegment")).otherwise(blank),
        F.when(case == 1, F.col("c_mktsegment")), F.lit("latest"), F.lit("syft"), F.lit("1.0"), F.when(case == 2, F.concat("c_name", F.lit(".json"))).otherwise(blank), F.sha2("c_name", 256),
    )
    return d.table("customer").select("c_custkey", shown.alias("shown"))


@query("B24_slug", "select p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_type || ')')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') slug from part")
def _(d):
    return d.table("part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"))


@query("B25_display_numbers", "select c_custkey, format('{:,}', c_custkey * 1234) shown from customer")
def _(d):
    return d.table("customer").select("c_custkey", F.format_number(F.col("c_custkey") * 1234, 0).alias("shown"))


@query("B27_title_words", "select distinct o_orderpriority, case o_orderpriority when '4-NOT SPECIFIED' then '4-not Specified' else substr(o_orderpriority, 1, 2) || lower(substr(o_orderpriority, 3)) end title from orders")
def _(d):
    return d.table("orders").select("o_orderpriority", T.title_words(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_"))).alias("title")).distinct()


@query("B28_edit_signature", """select doc_id, sha256('{"key":' || doc_id || ',"types":[' || least(toxic, quality) || ',' || greatest(toxic, quality) || ']}') signature from labels""")
def _(d):
    return d.table("labels").select("doc_id", review.edit_signature(F.col("doc_id"), F.array("toxic", "quality")).alias("signature"))


@query("G13_page_window", "select c_custkey, list_transform(range(greatest(1, least(p - 2, 8)), least(12, greatest(1, least(p - 2, 8)) + 4) + 1), lambda x: x::int) pages from (select c_custkey, (c_custkey % 12 + 1)::int p from customer)")
def _(d):
    return d.table("customer").select("c_custkey", T.page_window((F.col("c_custkey") % 12 + 1).cast("int"), F.lit(12)).alias("pages"))


@query("G14_total_pages", "select source, ceil(count(*) / 25.0)::bigint pages from documents group by 1")
def _(d):
    return d.table("documents").groupBy("source").agg(F.ceil(F.count("*") / 25).alias("pages"))


@query("C01_projection", over_domain("select cpe_name, vendor, product from cpe_names"))
def _(d):
    return d.names().select("cpe_name", "vendor", "product")


@query("C19_property_filter", "select event_id, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') <> '5'")
def _(d):
    found = T.candidate_values(F.map_entries(F.from_json("props", "map<string,string>")), "k", F.lit("5"))
    kept = d.table("events").select("event_id", F.filter(found, lambda c: ~c["is_primary"]).alias("candidates")).filter(F.size("candidates") > 0)
    return kept.select("event_id", F.get("candidates", F.lit(0))["value"].alias("value"))


def _entries():
    return F.array(F.struct(F.concat(F.lit("syft:Package:"), F.col("event_type")).alias("key"), F.col("props").alias("value")), F.struct(F.col("event_type").alias("key"), F.col("event_type").alias("value")))


@query("C20_relevant_properties", f"select event_id, case when {' or '.join(f"contains(event_type, '{t}')" for t in T.RELEVANT_TERMS)} then ['syft:Package:' || event_type, event_type] else ['syft:Package:' || event_type] end keys from events")
def _(d):
    kept = T.relevant_properties(_entries())
    return d.table("events").select("event_id", F.transform(kept, lambda p: p["key"]).alias("keys"))


@query("C23_equals_primary", "select event_id, [json_extract_string(props, '$.k') || ':' || case when json_extract_string(props, '$.k') = cast(event_id % 10 as varchar) then 'true' else 'false' end] candidates from events")
def _(d):
    entries = F.map_entries(F.from_json("props", "map<string,string>"))
    found = T.candidate_values(entries, "k", (F.col("event_id") % 10).cast("string"))
    return d.table("events").select("event_id", F.transform(found, lambda c: F.concat_ws(":", c["value"], c["is_primary"].cast("string"))).alias("candidates"))
