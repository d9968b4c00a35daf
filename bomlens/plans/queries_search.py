"""Filters, searches, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from bomlens.functions.text import any_contains_ci, equals_ci
from bomlens.operators import search
from bomlens.operators.search import ComponentQuery, DictionaryQuery
from bomlens.plans.domain import over_domain
from bomlens.plans.registry import query

_ROW = "id, cpe, name, version, repository, tag"


def _row(rows):
    return rows.select("id", "cpe", "name", "version", "repository", "tag")


@query("C02_equality", over_domain("select id, cpe_name from cpe_names where part = 'o'"))
def _(d):
    return d.names().filter("part = 'o'").select("id", "cpe_name")


@query("C03_present", over_domain("select id, cpe from components where cpe <> ''"))
def _(d):
    return search.filter_has_cpe(d.components(), "true").select("id", "cpe")


@query("C04_has_cpe_false", over_domain("select id, cpe from components where cpe = ''"))
def _(d):
    wanted = ComponentQuery(dictionary_status="NOT_PRESENT").wanted_cpe()
    return search.filter_has_cpe(d.components(), wanted).select("id", "cpe")


for _status, _where in {
    "OFFICIAL_ACTIVE": "exists (select 1 from cpe_names n where n.cpe_name = l.cpe and not n.deprecated)",
    "OFFICIAL_DEPRECATED": "exists (select 1 from cpe_names n where n.cpe_name = l.cpe and n.deprecated)",
    "NOT_IN_DICTIONARY": "cpe <> '' and not exists (select 1 from cpe_names n where n.cpe_name = l.cpe)",
    "NOT_PRESENT": "cpe = ''",
}.items():
    query(f"C05_status_{_status.lower()}", over_domain(f"select {_ROW} from located l where {_where}"))(
        lambda d, status=_status: _row(search.filter_status(d.located(), d.names(), status))
    )


@query("C06_equals_ci", over_domain("select id, cpe_name from cpe_names where lower(vendor) = lower('BRAND\\#12')"))
def _(d):
    return d.names().filter(equals_ci(F.col("vendor"), "BRAND\\#12")).select("id", "cpe_name")


@query("C07_exact_name", over_domain("select id, cpe_name from cpe_names where cpe_name = (select max(cpe_name) from cpe_names where id = 7)"))
def _(d):
    one = d.names().filter("id = 7").agg(F.max("cpe_name").alias("cpe_name"))
    return d.names().join(F.broadcast(one), "cpe_name", "left_semi").select("id", "cpe_name")


@query("C08_dictionary_contains", over_domain("select id, cpe_name from cpe_names where contains(lower(cpe_name), '#1') or contains(lower(vendor), '#1') or contains(lower(product), '#1') or contains(lower(version), '#1')"))
def _(d):
    return d.names().filter(any_contains_ci("#1", "cpe_name", "vendor", "product", "version")).select("id", "cpe_name")


@query("C09_component_contains", over_domain("select id, cpe from components where contains(lower(name), 'syft') or contains(lower(version), 'syft') or contains(lower(cpe), 'syft') or contains(lower(bom_ref), 'syft')"))
def _(d):
    return search.search_components(d.components(), "SYFT").select("id", "cpe")


@query("C10_type_contains", "select s_suppkey from supplier where contains(lower(s_name), '#00000000')")
def _(d):
    return d.table("supplier").filter(any_contains_ci("#00000000", "s_name")).select("s_suppkey")


@query("C11_deprecated_only", over_domain("select id from cpe_names where deprecated"))
def _(d):
    return search.filter_deprecated(d.names(), "deprecated").select("id")


@query("C12_active_only", "select c_custkey from customer where c_acctbal >= 0")
def _(d):
    return d.table("customer").withColumn("is_active", F.col("c_acctbal") >= 0).filter("is_active").select("c_custkey")


@query("C13_image_scope", over_domain("select id, cpe from located where docker_image_id = 3"))
def _(d):
    return search.filter_scope(d.located(), image=3).select("id", "cpe")


@query("C13_sbom_scope", over_domain("select id, cpe from located where sbom_document_id = 5"))
def _(d):
    return search.filter_scope(d.located(), sbom=5).select("id", "cpe")


@query("C21_image_search", over_domain("select id, repository from images where contains(lower(repository), '_1') or contains(lower(tag), '_1') or contains(lower(platform), '_1')"))
def _(d):
    return d.images().filter(any_contains_ci("_1", "repository", "tag", "platform")).select("id", "repository")


@query("C22_picker", "select s_suppkey, lower(s_name) = 'supplier#000000003' exact from supplier where contains(lower(s_name), '00003')")
def _(d):
    rows = d.table("supplier").filter(any_contains_ci("00003", "s_name"))
    return rows.select("s_suppkey", equals_ci(F.col("s_name"), "Supplier#000000003").alias("exact"))


@query("C25_managed_types", "select c_custkey from customer where contains(lower(c_name), '12') or contains(lower(c_mktsegment), '12')")
def _(d):
    return d.table("customer").filter(any_contains_ci("12", "c_name", "c_mktsegment")).select("c_custkey")


_ORDER = "repository asc nulls last, tag asc nulls last, name, version, id"


@query("G01_default_order", over_domain(f"select {_ROW} from located where cpe <> '' order by {_ORDER} limit 100"))
def _(d):
    return _row(search.components_list(d.located(), d.names(), ComponentQuery()).limit(100))


@query("G02_user_order", over_domain(f"select {_ROW} from located where cpe <> '' order by repository desc nulls first, name, id limit 100"))
def _(d):
    return _row(search.components_list(d.located(), d.names(), ComponentQuery(ordering="-repository,name")).limit(100))


@query("G04_dictionary_order", over_domain("select id, cpe_name from cpe_names where contains(lower(product), 'a') or contains(lower(cpe_name), 'a') order by deprecated, vendor, product, version, cpe_name limit 100"))
def _(d):
    return d.names().filter(any_contains_ci("a", "product", "cpe_name")).orderBy(*search.dictionary_order()).limit(100).select("id", "cpe_name")


@query("G06_ci_order", "select s_suppkey, s_name from supplier order by lower(s_name), s_suppkey limit 20")
def _(d):
    return d.table("supplier").orderBy(F.lower("s_name"), "s_suppkey").limit(20).select("s_suppkey", "s_name")


@query("G08_component_page", over_domain(f"select {_ROW} from located where cpe <> '' order by {_ORDER} limit 50 offset 100"))
def _(d):
    return _row(search.page(search.components_list(d.located(), d.names(), ComponentQuery()), 3, 50))


@query("G08_envelope", over_domain("select count(*) count, 3 page, 50 page_size, greatest(1, ceil(count(*) / 50.0))::int total_pages, case when 3 < ceil(count(*) / 50.0) then 4 end next_page, 2 previous_page from located where cpe <> ''"))
def _(d):
    return search.envelope(search.filter_has_cpe(d.components(), "true"), 3, 50)


@query("G09_dictionary_page", over_domain("select id, cpe_name from cpe_names where part = 'a' and not deprecated and contains(lower(cpe_name), 'brand') order by deprecated, vendor, product, version, cpe_name limit 25 offset 25"))
def _(d):
    return search.dictionary_page(d.names(), DictionaryQuery(q="brand", part="a", page=2)).select("id", "cpe_name")


@query("G11_table_sort", over_domain("select id, repository, tag from images order by repository, tag, id"))
def _(d):
    return d.images().orderBy("repository", "tag", "id").select("id", "repository", "tag")


@query("A17_snapshot_filter", "select 'complete' snapshot_id, count(*) as \"names\" from part")
def _(d):
    snapshots = d.spark.createDataFrame([("complete", "COMPLETE"), ("running", "IMPORTING")], "snapshot_id string, status string")
    chosen = search.select_snapshot(snapshots)
    return d.names().agg(F.lit(chosen).alias("snapshot_id"), F.count("*").alias("names"))
