"""Joins, semi joins, set operations and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bomlens.functions.cpe import present
from bomlens.operators import checks, matching, overview, review, search
from bomlens.plans.domain import over_domain
from bomlens.plans.registry import query
from bomlens.sources import sbom


def _docs(d):
    return d.table("documents").select(F.col("doc_id").alias("id"), "source", "lang")


def _reviews(d):
    return d.reviews().withColumn("outcome", review.outcome(F.col("ground_truth_cpe"), F.col("original_cpe"), F.col("manual_ground_truth_cpe")))


@query("D01_located_components", over_domain("select id, sbom_document_id, docker_image_id, repository, tag, cpe from located"))
def _(d):
    return d.located().select("id", "sbom_document_id", "docker_image_id", "repository", "tag", "cpe")


@query("D02_exact_match", over_domain("select cpe, name_id, deprecated, match_status from matched"))
def _(d):
    return matching.exact_match(d.components(), d.names())


@query("F03_distinct_lookups", over_domain("select distinct cpe from components"))
def _(d):
    return matching.distinct_names(d.components())


@query("D03_active_components", over_domain("select c.id, c.cpe from components c semi join cpe_names n on n.cpe_name = c.cpe and not n.deprecated"))
def _(d):
    return matching.with_dictionary_row(d.components(), d.names(), False).select("id", "cpe")


@query("D04_deprecated_components", over_domain("select c.id, c.cpe from components c semi join cpe_names n on n.cpe_name = c.cpe and n.deprecated"))
def _(d):
    return matching.with_dictionary_row(d.components(), d.names(), True).select("id", "cpe")


@query("D05_missing_components", over_domain("select c.id, c.cpe from components c anti join cpe_names n on n.cpe_name = c.cpe where c.cpe <> ''"))
def _(d):
    return matching.not_in_dictionary(d.components(), d.names()).select("id", "cpe")


@query("C18_membership", over_domain("select c.id, c.cpe from components c semi join (select cpe_name from cpe_names where part = 'o') n on n.cpe_name = c.cpe"))
def _(d):
    wanted = d.names().filter("part = 'o'").select(F.col("cpe_name").alias("cpe"))
    return d.components().join(wanted, "cpe", "left_semi").select("id", "cpe")


@query("D06_unreviewed", over_domain("select doc_id id, source, lang from documents d anti join reviews r on r.component_id = d.doc_id"))
@query("C14_unreviewed", over_domain("select doc_id id, source, lang from documents d anti join reviews r on r.component_id = d.doc_id"))
def _(d):
    return review.queue(_docs(d), _reviews(d))


@query("C14_completed", over_domain("select doc_id id, source, lang from documents d semi join reviews r on r.component_id = d.doc_id"))
def _(d):
    return review.queue(_docs(d), _reviews(d), "COMPLETED")


@query("C15_outcome_filter", over_domain("select doc_id id, source, lang from documents d semi join outcomes r on r.component_id = d.doc_id and r.outcome = 'CORRECTED_TO_DICTIONARY'"))
def _(d):
    return review.queue(_docs(d), _reviews(d), "ALL", (review.CORRECTED,))


@query("C16_empty_queue", "select doc_id id, source, lang from documents where false")
def _(d):
    return review.queue(_docs(d), _reviews(d), "NOT_PRESENT")


@query("G07_queue_order", over_domain("select doc_id id, source, lang from documents d anti join reviews r on r.component_id = d.doc_id order by id desc limit 50"))
def _(d):
    return review.queue(_docs(d), _reviews(d)).orderBy(F.desc("id")).limit(50)


@query("F01_neighbours", over_domain("select max(doc_id) filter (doc_id < 100) previous_id, min(doc_id) filter (doc_id > 100) next_id from documents d anti join reviews r on r.component_id = d.doc_id"))
def _(d):
    return review.neighbours(review.queue(_docs(d), _reviews(d)), 100)


@query("F01_neighbours_descending", over_domain("select min(doc_id) filter (doc_id > 100) previous_id, max(doc_id) filter (doc_id < 100) next_id from documents d anti join reviews r on r.component_id = d.doc_id"))
def _(d):
    return review.neighbours(review.queue(_docs(d), _reviews(d)), 100, descending=True)


@query("F01_all_neighbours", "select conv_id, turn, lag(turn) over (partition by conv_id order by turn) previous_id, lead(turn) over (partition by conv_id order by turn) next_id from conversations")
def _(d):
    return review.all_neighbours(d.table("conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("F02_first_match", over_domain("select min(id) id from images where tag = 'asia'"))
def _(d):
    return d.images().filter("tag = 'asia'").agg(F.min("id").alias("id"))


@query("B07_outcomes", over_domain("select component_id, outcome from outcomes"))
def _(d):
    return _reviews(d).select("component_id", "outcome")


@query("B08_corrections_allowed", over_domain("select component_id, outcome in ('CORRECTED_TO_DICTIONARY', 'MANUAL_FROM_OFFICIAL_FAMILY') allowed from outcomes"))
def _(d):
    return _reviews(d).select("component_id", review.allows_corrections(F.col("outcome")).alias("allowed"))


@query("B16_review_source", over_domain("select component_id, case when ground_truth_cpe is not null then 'DICTIONARY' when manual_ground_truth_cpe <> '' then 'MANUAL' else 'NONE' end as source, nullif(manual_ground_truth_cpe, '') manual_cpe, outcome from outcomes"))
def _(d):
    return _reviews(d).select("component_id", review.source(F.col("ground_truth_cpe"), F.col("manual_ground_truth_cpe")).alias("source"), F.nullif(F.col("manual_ground_truth_cpe"), F.lit("")).alias("manual_cpe"), "outcome")


_PAGE = "select id, name, version, cpe, repository, tag from located where cpe <> '' order by repository asc nulls last, tag asc nulls last, name, version, id limit 50"


@query("D11_page_enriched", over_domain(f"select p.id, p.cpe, case when n.cpe_name is null then 'NOT_IN_DICTIONARY' when n.deprecated then 'OFFICIAL_DEPRECATED' else 'OFFICIAL_ACTIVE' end match_status from ({_PAGE}) p left join cpe_names n on n.cpe_name = p.cpe"))
def _(d):
    rows = d.located().filter(present(F.col("cpe"))).orderBy(*search.default_order())
    page = search.page(rows).select("id", "cpe")
    names = d.names().select(F.col("cpe_name").alias("cpe"), "deprecated")
    return page.join(names, "cpe", "left").select("id", "cpe", matching.match_status(F.col("cpe"), F.col("deprecated")).alias("match_status"))


@query("D07_metadata_mismatches", "select n_nationkey as \"key\", list_filter([case when a.n_name <> upper(r_name) then 'name' end, case when a.n_regionkey <> n_nationkey % 5 then 'region' end], lambda x: x is not null) differing from nation a join region on r_regionkey = n_regionkey where a.n_name <> upper(r_name) or a.n_regionkey <> n_nationkey % 5")
@query("A26_existing_images", "select n_nationkey as \"key\", list_filter([case when a.n_name <> upper(r_name) then 'name' end, case when a.n_regionkey <> n_nationkey % 5 then 'region' end], lambda x: x is not null) differing from nation a join region on r_regionkey = n_regionkey where a.n_name <> upper(r_name) or a.n_regionkey <> n_nationkey % 5")
def _(d):
    existing = d.table("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    joined = d.table("nation").join(d.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    incoming = joined.select(F.col("n_nationkey").alias("key"), F.upper("r_name").alias("name"), (F.col("n_nationkey") % 5).alias("region"))
    return checks.metadata_mismatches(existing, incoming, "key", ["name", "region"])


@query("A27_same_hash_metadata", "with h as (select sha256(text) sha, min(doc_id) doc_id, min(lang) lang, min(source) source from documents group by 1), o as (select sha256(text) sha, max(lang) lang, max(source) source from documents group by 1) select h.sha, list_filter([case when h.lang <> o.lang then 'lang' end, case when h.source <> o.source then 'source' end], lambda x: x is not null) differing from h join o using (sha) where h.lang <> o.lang or h.source <> o.source")
def _(d):
    docs = d.table("documents").withColumn("sha", F.sha2(F.col("text"), 256))
    first = docs.groupBy("sha").agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    last = docs.groupBy("sha").agg(F.max("lang").alias("lang"), F.max("source").alias("source"))
    return checks.metadata_mismatches(first, last, "sha", ["lang", "source"])


_D08 = "select coalesce(a.k, b.k) as \"key\", case when b.k is null then 'missing' else 'extra' end as side from (select distinct o_custkey k from orders) a full join (select c_custkey k from customer where c_custkey % 3 > 0) b on a.k = b.k where a.k is null or b.k is null"


@query("D08_reconciliation", _D08)
@query("A20_file_bijection", _D08)
@query("H01_missing_and_extra", _D08)
def _(d):
    expected = d.table("orders").select(F.col("o_custkey").alias("key"))
    return checks.missing_and_extra(expected, d.table("customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("key")), "key")


@query("D09_nested_sboms", over_domain("select i.id, i.repository, i.tag, i.platform, coalesce(list(s.id || ' ' || s.source_path order by s.id) filter (s.id is not null), []) documents from images i left join sboms s on s.docker_image_id = i.id group by all"))
def _(d):
    nested = overview.sboms_of_images(d.images(), d.sboms())
    return nested.withColumn("documents", F.transform("documents", lambda x: F.concat_ws(" ", x["id"].cast("string"), x["source_path"])))


@query("D10_nested_types", "select doc_id id, list_sort(list(distinct t)) types from (select doc_id, unnest(list_filter([case when quality = 1 then 'quality' end, case when toxic = 1 then 'toxic' end], lambda x: x is not null)) t from labels) group by 1")
def _(d):
    bridge = d.table("labels").select(F.col("doc_id").alias("ground_truth_id"), F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))).alias("name"))
    return overview.types_of_reviews(bridge).withColumnRenamed("ground_truth_id", "id")


@query("D14_foreign_violations", "select l_orderkey * 10 + l_linenumber component_id, l_partkey dictionary_cpe_id from lineitem semi join (select p_partkey from part where p_partkey % 10 = 0) p on p.p_partkey = l_partkey where l_quantity > 49")
def _(d):
    requests = d.table("lineitem").filter("l_quantity > 49").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("component_id"), F.col("l_partkey").alias("dictionary_cpe_id"))
    names = d.names().select("id", F.when(F.col("id") % 10 == 0, "old").otherwise("current").alias("snapshot_id"))
    return review.foreign_names(requests, names, "current")


@query("H02_missing_keys", "select event_id, list_filter(['k', 'value'], lambda x: not list_contains(json_keys(props), x)) missing from events")
def _(d):
    return d.table("events").select("event_id", checks.missing_keys(F.json_object_keys("props"), ("k", "value")).alias("missing"))


@query("H04_new_inactive", "select o_orderkey component_id, o_custkey correction_type_id from orders semi join (select c_custkey from customer where c_acctbal < 1000) c on c.c_custkey = o_custkey where o_orderkey % 3 > 0")
def _(d):
    chosen = d.table("orders").select(F.col("o_orderkey").alias("component_id"), F.col("o_custkey").alias("correction_type_id"))
    types = d.table("customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 1000).alias("is_active"))
    return review.newly_inactive(chosen, types, chosen.filter("component_id % 3 = 0"))


_A29 = "select sha256(text) sha, min(doc_id) existing_id, count(*) as \"rows\" from documents group by 1 having count(*) > 1"


@query("A29_upload_duplicates", _A29)
def _(d):
    docs = d.table("documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text"), 256).alias("file_sha256"))
    first = docs.groupBy("file_sha256").agg(F.min("id").alias("id"))
    found = sbom.duplicate_uploads(docs.drop("id"), first).groupBy("file_sha256", "existing_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    return found.withColumnRenamed("file_sha256", "sha")
