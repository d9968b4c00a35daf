"""Aggregations, mismatch analysis, profile, overviews and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bomlens.functions.cpe import parse
from bomlens.operators import checks, matching, mismatch, overview, profile, review
from bomlens.plans.domain import over_domain
from bomlens.plans.registry import query

NAMED = "select c.*, a.status, a.part, a.vendor, a.product, a.version cpe_version from located c join attrs a using (cpe) where cpe <> ''"
STATUS_VALUES = "(values ('STRUCTURALLY_VALID'),('INVALID_PREFIX'),('INVALID_FIELD_COUNT'),('INVALID_ESCAPE'),('INVALID_PART'))"


def _mismatches(d):
    return mismatch.mismatches(d.components(), d.names())


def _parsed(d):
    return profile.parsed_components(d.located())


@query("E01_component_count", over_domain("select count(*) components from components"))
def _(d):
    return d.components().agg(F.count("*").alias("components"))


@query("E02_image_coverage", over_domain("select docker_image_id, count(*) total, count(*) filter (cpe <> '') with_cpe from located where docker_image_id is not null group by 1"))
def _(d):
    return profile.image_coverage(d.located())


_E03 = """select i.id, i.repository, i.tag, count(distinct s.id) sboms, count(c.id) components, count(c.id) filter (c.cpe <> '') with_cpe, count(distinct c.cpe) filter (c.cpe <> '') unique_cpes,
 case when count(c.id) = 0 then 0.0 else (count(c.id) filter (c.cpe <> ''))::double / count(c.id) end ratio
 from images i left join sboms s on s.docker_image_id = i.id left join components c on c.sbom_document_id = s.id group by i.id, i.repository, i.tag"""


@query("E03_image_stats", over_domain(_E03))
@query("D12_images_left_chain", over_domain(_E03))
def _(d):
    return overview.image_overview(d.images(), d.sboms(), d.components())


@query("B05_safe_ratio", over_domain(f"select id, ratio from ({_E03})"))
def _(d):
    return overview.image_overview(d.images(), d.sboms(), d.components()).select("id", "ratio")


_E04 = "select s.id, s.docker_image_id, s.source_path, s.imported_at, count(c.id) components from sboms s left join components c on c.sbom_document_id = s.id group by all"


@query("E04_sbom_components", over_domain(_E04))
def _(d):
    return overview.sbom_overview(d.sboms(), d.components())


@query("G05_sboms_newest", over_domain(f"select * from ({_E04}) order by imported_at desc, id desc limit 50"))
def _(d):
    return overview.newest_first(overview.sbom_overview(d.sboms(), d.components())).limit(50)


@query("E05_type_usage", "select id, name, count(distinct doc_id) usage_count from (select distinct quality * 2 + toxic id, concat('kind-', quality * 2 + toxic) as name from labels) t left join (select doc_id, quality * 2 + toxic k from labels where toxic = 1) u on u.k = t.id group by id, name")
def _(d):
    labels = d.table("labels").withColumn("k", F.col("quality") * 2 + F.col("toxic"))
    types = labels.select(F.col("k").alias("id"), F.concat(F.lit("kind-"), F.col("k").cast("string")).alias("name")).distinct()
    return overview.type_usage(types, labels.filter("toxic = 1").select(F.col("k").alias("correction_type_id"), F.col("doc_id").alias("ground_truth_id")))


@query("E06_cpe_counts", over_domain("select * from usage"))
def _(d):
    return matching.usage(d.components())


@query("E07_status_counts", over_domain(f"select v.status, count(n.id) components, count(distinct n.cpe) unique_cpes from {STATUS_VALUES} v(status) left join ({NAMED}) n on n.status = v.status group by v.status"))
def _(d):
    return profile.status_counts(_parsed(d))


@query("E07_part_counts", over_domain(f"select v.part, count(n.id) components, count(distinct n.cpe) unique_cpes from (values ('a'),('o'),('h')) v(part) left join ({NAMED}) n on n.part = v.part group by v.part"))
def _(d):
    return profile.part_counts(_parsed(d))


_KIND = "case cpe_version when '*' then 'wildcard' when '-' then 'NA' else 'explicit' end"


@query("E07_version_counts", over_domain(f"select v.version_kind, count(n.id) components, count(distinct n.cpe) unique_cpes from (values ('wildcard'),('NA'),('explicit')) v(version_kind) left join (select *, {_KIND} k from ({NAMED}) where status = 'STRUCTURALLY_VALID') n on n.k = v.version_kind group by v.version_kind"))
def _(d):
    return profile.version_counts(_parsed(d))


@query("E07_vendor_counts", over_domain(f"select vendor, count(*) components, count(distinct cpe) unique_cpes from ({NAMED}) where status = 'STRUCTURALLY_VALID' group by vendor"))
def _(d):
    return profile.vendor_counts(_parsed(d))


@query("E08_vendor_products", over_domain(f"select part, vendor, product, count(*) components, count(distinct cpe) unique_cpes, count(distinct docker_image_id) images from ({NAMED}) where status = 'STRUCTURALLY_VALID' group by 1, 2, 3"))
def _(d):
    return profile.vendor_products(_parsed(d))


@query("G12_vendor_product_order", over_domain(f"select part, vendor, product, count(*) components from ({NAMED}) where status = 'STRUCTURALLY_VALID' group by 1, 2, 3 order by 1, 2, 3 limit 100"))
def _(d):
    return profile.vendor_products(_parsed(d)).select("part", "vendor", "product", "components").orderBy("part", "vendor", "product").limit(100)


_E09 = f"""select cpe, status, count(*) components, count(distinct docker_image_id) images, count(distinct sbom_document_id) sboms, count(distinct name) "names",
 coalesce(array_to_string(list_sort(list(distinct repository) filter (repository is not null)), '|'), '') repositories, array_to_string(list_sort(list(distinct name)), '|') component_names from ({NAMED}) group by cpe, status"""


@query("E09_cpe_usage", over_domain(_E09))
def _(d):
    return profile.cpe_usage(_parsed(d))


@query("B06_joined_distinct", over_domain(f"select cpe, repositories from ({_E09})"))
def _(d):
    return profile.cpe_usage(_parsed(d)).select("cpe", "repositories")


@query("E10_invalid_cpes", over_domain(f"select * from ({_E09}) where status <> 'STRUCTURALLY_VALID'"))
def _(d):
    return profile.invalid_usage(profile.cpe_usage(_parsed(d)))


_E11 = f"""select i.id, i.repository, i.tag, coalesce(t.total, 0) total, coalesce(t.with_cpe, 0) with_cpe, case when coalesce(t.total, 0) = 0 then 0.0 else t.with_cpe::double / t.total end ratio, coalesce(p.valid, 0) as valid, coalesce(p.invalid, 0) as invalid, coalesce(p.u, 0) unique_cpes
 from images i left join (select docker_image_id, count(*) total, count(*) filter (cpe <> '') with_cpe from located where docker_image_id is not null group by 1) t on t.docker_image_id = i.id
 left join (select docker_image_id, count(*) filter (status = 'STRUCTURALLY_VALID') as valid, count(*) filter (status <> 'STRUCTURALLY_VALID') as invalid, count(distinct cpe) u from ({NAMED}) group by 1) p on p.docker_image_id = i.id"""


def _summary(d):
    return profile.image_summary(d.images(), profile.name_counts(d.located()))


@query("E11_image_summary", over_domain(_E11))
def _(d):
    return _summary(d)


@query("E12_profile_summary", over_domain(f"select sum(total)::bigint total_components, sum(with_cpe)::bigint components_with_cpe, count(*) images, (select count(*) from usage) unique_cpes, (select count(*) from usage where component_count > 1) reused_primary_cpes, (select count(*) from components) all_components, case when sum(total) = 0 then 0.0 else sum(with_cpe)::double / sum(total)::double end ratio from ({_E11})"))
def _(d):
    return profile.profile_summary(d.images(), profile.name_counts(d.located()))


_E13 = """select v.match_status, coalesce(u, 0) unique_cpes, coalesce(n, 0) components from (values ('OFFICIAL_ACTIVE'),('OFFICIAL_DEPRECATED'),('NOT_IN_DICTIONARY'),('NOT_PRESENT')) v(match_status)
 left join (select match_status, count(*) filter (m.cpe <> '') u, sum(k)::bigint n from matched m join (select cpe, count(*) k from components group by cpe) c on c.cpe = m.cpe group by 1) x using (match_status)"""


@query("E13_match_counts", over_domain(_E13))
def _(d):
    return matching.match_counts(d.components(), d.names())


@query("J04_match_identities", over_domain(f"""select count(*) = 4 four_statuses, sum(unique_cpes) filter (match_status = 'NOT_PRESENT') = 0 blank_is_no_name, min(components) >= 0 no_negative,
 count(*) filter (components < unique_cpes) = 0 components_cover_names, count(*) filter (unique_cpes = 0 and components > 0 and match_status <> 'NOT_PRESENT') = 0 names_behind_components from ({_E13})"""))
def _(d):
    return checks.match_identities(matching.match_counts(d.components(), d.names()))


@query("E14_grouped_names", over_domain("select g.part, g.vendor, g.product, g.version, total, active, deprecated_n deprecated from grouped g semi join (select distinct a.part, a.product from attrs a join matched m using (cpe) where m.match_status = 'NOT_IN_DICTIONARY' and a.status = 'STRUCTURALLY_VALID') k on k.part = g.part and k.product = g.product"))
def _(d):
    parsed = mismatch.population(d.components(), d.names())
    return mismatch.grouped_names(mismatch.relevant_names(d.names(), parsed))


@query("C17_compound_keys", over_domain("select id, cpe_name from cpe_names n semi join (select distinct a.part, a.product from attrs a join matched m using (cpe) where m.match_status = 'NOT_IN_DICTIONARY' and a.status = 'STRUCTURALLY_VALID') k on k.part = n.part and k.product = n.product"))
def _(d):
    return mismatch.relevant_names(d.names(), mismatch.population(d.components(), d.names())).select("id", "cpe_name")


@query("E15_rollup_three", over_domain("select part, vendor, product, total, active, deprecated_n deprecated from three"))
def _(d):
    return mismatch.rolled_up(mismatch.grouped_names(d.names()), "three")


@query("E15_rollup_two", over_domain("select part, product, total, active, deprecated_n deprecated from two"))
def _(d):
    return mismatch.rolled_up(mismatch.grouped_names(d.names()), "two")


_ALL = "cpe, status, part, vendor, product, version, component_count, four_total, four_active, four_deprecated, three_total, three_active, three_deprecated, two_total, two_active, two_deprecated, profile"


@query("D13_mismatch_rows", over_domain(f"select {_ALL} from mismatch"))
def _(d):
    return _mismatches(d)


@query("B15_mismatch_profile", over_domain("select cpe, profile from mismatch"))
def _(d):
    return _mismatches(d).select("cpe", "profile")


@query("G03_mismatch_order", over_domain("select profile, component_count, cpe from mismatch order by profile, component_count desc, cpe limit 200"))
def _(d):
    return mismatch.report_order(_mismatches(d)).select("profile", "component_count", "cpe").limit(200)


_PROFILES = "(values ('SAME_PART_VENDOR_PRODUCT_VERSION'),('SAME_PART_VENDOR_PRODUCT'),('SAME_PART_PRODUCT'),('NO_STRUCTURED_MATCH'),('UNPARSABLE'))"


@query("E16_mismatch_counts", over_domain(f"select v.profile, count(m.cpe) unique_cpes, coalesce(sum(component_count), 0)::bigint components from {_PROFILES} v(profile) left join mismatch m on m.profile = v.profile group by v.profile"))
def _(d):
    return mismatch.profile_counts(_mismatches(d))


@query("E17_field_histogram", over_domain(" union all ".join(f"select '{f}' field, {f} as value, count(*) unique_cpes, sum(component_count)::bigint components from mismatch where status = 'STRUCTURALLY_VALID' group by 2" for f in ("part", "vendor", "product", "version"))))
def _(d):
    return mismatch.field_histogram(_mismatches(d))


@query("E18_profile_by_part", over_domain("select case when status = 'STRUCTURALLY_VALID' then part else '<unparsable>' end part, " + ", ".join(f"count(*) filter (profile = '{p}') \"{p}\"" for p in mismatch.PROFILES) + " from mismatch group by 1"))
def _(d):
    return mismatch.profile_by_part(_mismatches(d))


@query("E19_key_counts", over_domain("select count(distinct (part, vendor, product, version)) four_keys, count(distinct (part, vendor, product)) three_keys, count(distinct (part, product)) two_keys from mismatch where status = 'STRUCTURALLY_VALID'"))
def _(d):
    return mismatch.key_counts(_mismatches(d))


@query("H03_distinct_keys", over_domain("select distinct part, vendor, product from mismatch where status = 'STRUCTURALLY_VALID'"))
def _(d):
    return mismatch.keys_of_interest(mismatch.population(d.components(), d.names()), "three")


@query("E20_import_tallies", over_domain("select count(distinct sbom_document_id) documents, count(*) components, count(*) filter (cpe <> '') with_cpe from components"))
def _(d):
    return d.components().agg(F.countDistinct("sbom_document_id").alias("documents"), F.count("*").alias("components"), F.count_if(F.col("cpe") != "").alias("with_cpe"))


@query("E21_overview_totals", over_domain(f"select sum(components)::bigint components, sum(with_cpe)::bigint with_cpe, count(*) images, case when sum(components) = 0 then 0.0 else sum(with_cpe)::double / sum(components)::double end coverage from ({_E03})"))
def _(d):
    return overview.totals(overview.image_overview(d.images(), d.sboms(), d.components()))


@query("E22_feed_totals", over_domain("select count(*) total, count(*) filter (not deprecated) active, count(*) filter (deprecated) deprecated from cpe_names"))
@query("A14_feed_counts", over_domain("select count(*) total, count(*) filter (not deprecated) active, count(*) filter (deprecated) deprecated from cpe_names"))
def _(d):
    return d.names().agg(F.count("*").alias("total"), F.count_if(~F.col("deprecated")).alias("active"), F.count_if("deprecated").alias("deprecated"))


@query("J01_duplicate_lines", "select l_orderkey, l_linenumber, count(*) as \"rows\" from lineitem group by 1, 2 having count(*) > 1")
def _(d):
    return checks.duplicates(d.table("lineitem"), "l_orderkey", "l_linenumber")


@query("J02_unique_component_refs", over_domain("select sbom_document_id, bom_ref, count(*) as \"rows\" from (select * from components union all select * from components where id % 50 = 0) group by 1, 2 having count(*) > 1"))
def _(d):
    found = d.components()
    return checks.duplicates(found.unionByName(found.filter("id % 50 = 0")), "sbom_document_id", "bom_ref")


@query("J03_duplicate_names", over_domain("select cpe_name, count(*) as \"rows\" from (select * from cpe_names union all select * from cpe_names where id % 20 = 0) group by 1 having count(*) > 1"))
def _(d):
    found = d.names()
    return checks.duplicates(found.unionByName(found.filter("id % 20 = 0")), "cpe_name")


_BROKEN = "select * replace (four_total + (length(cpe) % 5 = 0)::int as four_total, component_count * (length(cpe) % 7 > 0)::int as component_count) from mismatch"


@query("J05_mismatch_violations", over_domain(f"""select cpe, 'four_total' as rule from ({_BROKEN}) where four_total <> four_active + four_deprecated union all select cpe, 'levels' from ({_BROKEN}) where four_total > three_total or three_total > two_total
 union all select cpe, 'profile' from ({_BROKEN}) where profile <> case when status <> 'STRUCTURALLY_VALID' then 'UNPARSABLE' when four_total > 0 then 'SAME_PART_VENDOR_PRODUCT_VERSION' when three_total > 0 then 'SAME_PART_VENDOR_PRODUCT' when two_total > 0 then 'SAME_PART_PRODUCT' else 'NO_STRUCTURED_MATCH' end
 union all select cpe, 'component_count' from ({_BROKEN}) where component_count < 1"""))
def _(d):
    broken = {"four_total": F.col("four_total") + (F.length("cpe") % 5 == 0).cast("int"), "component_count": F.col("component_count") * (F.length("cpe") % 7 > 0).cast("int")}
    return checks.mismatch_violations(_mismatches(d).withColumns(broken))


@query("J06_row_identities", over_domain("select count(*) as \"rows\", count(*) filter (two_total = two_active + two_deprecated and four_total <= three_total and three_total <= two_total) consistent from mismatch"))
def _(d):
    found = _mismatches(d)
    ok = (F.col("two_total") == F.col("two_active") + F.col("two_deprecated")) & (F.col("four_total") <= F.col("three_total")) & (F.col("three_total") <= F.col("two_total"))
    return found.agg(F.count("*").alias("rows"), F.count_if(ok).alias("consistent"))


@query("J07_no_exact_match_inside", over_domain("select m.cpe from (select cpe from mismatch union all select cpe_name from cpe_names where id % 25 = 0) m semi join cpe_names n on n.cpe_name = m.cpe"))
def _(d):
    planted = d.names().filter("id % 25 = 0").select(F.col("cpe_name").alias("cpe"))
    return checks.exact_matches_inside(_mismatches(d).select("cpe").unionByName(planted), d.names())


#: Planted requests to write reviews, one rule or more broken by most of them, with the tables that they are held against.
_REQUESTS = """req as (select doc_id component_id, case when doc_id % 12 in (0, 1, 2, 3, 8) then 1 + doc_id % 50 when doc_id % 12 = 9 then -1 end name_id,
  case doc_id % 12 when 4 then ' cpe:2.3:a:v:p:1:*:*:*:*:*:*:* ' when 5 then 'broken' when 8 then 'cpe:2.3:a:v:p:1:*:*:*:*:*:*:*' end manual,
  case doc_id % 12 when 1 then [1] when 2 then [2, 2] when 3 then [3] when 4 then [3] when 6 then [1] when 7 then [9] else [] end ids, doc_id % 12 = 10 odd from labels),
held as (select *, coalesce(trim(manual), '') m, case when doc_id_name is null then null else doc_id_name end gt from (select req.*, n.cpe_name doc_id_name from req left join cpe_names n on n.id = req.name_id)),
done as (select held.*, case when gt = o.cpe_name then 'C' when gt is not null then 'D' when m <> '' then 'M' else 'N' end ended from held left join cpe_names o on held.component_id % 3 = 0 and o.id = 1 + held.component_id % 50)"""
_RULES = {
    "unknown_field": "odd", "repeated_type": "len(ids) <> len(list_distinct(ids))", "unknown_name": "name_id is not null and gt is null", "two_sources": "gt is not null and m <> ''", "invalid_manual": "m = 'broken'",
    "corrections_forbidden": "ended in ('C', 'N') and len(ids) > 0", "unknown_type": "list_contains(ids, 9)", "inactive_type": "list_contains(ids, 3) and component_id % 24 <> 4", "other_snapshot": "gt is not null and name_id % 10 = 0",
}


def _write_violations(d):
    doc, m = F.col("doc_id"), F.col("doc_id") % 12
    requests = d.table("labels").select(
        doc.alias("component_id"),
        F.when(m.isin(0, 1, 2, 3, 8), 1 + doc % 50).when(m == 9, -1).alias("dictionary_cpe_id"),
        F.when(m == 4, " cpe:2.3:a:v:p:1:*:*:*:*:*:*:* ").when(m == 5, "broken").when(m == 8, "cpe:2.3:a:v:p:1:*:*:*:*:*:*:*").alias("manual_cpe"),
        F.when(m.isin(1, 6), F.array(F.lit(1))).when(m == 2, F.array(F.lit(2), F.lit(2))).when(m.isin(3, 4), F.array(F.lit(3))).when(m == 7, F.array(F.lit(9))).otherwise(F.array().cast("array<int>")).cast("array<bigint>").alias("correction_type_ids"),
        F.when(m == 10, F.array(F.lit("note"), F.lit("colour"))).otherwise(F.array(F.lit("note"))).alias("given"),
    )
    names = d.names().select("id", "cpe_name", F.when(F.col("id") % 10 == 0, "s0").otherwise("s1").alias("snapshot_id"))
    own = names.select((F.col("id") - 1).alias("k"), F.col("cpe_name").alias("cpe"))
    components = d.table("labels").filter("doc_id % 3 = 0").select(doc.alias("id"), (doc % 50).alias("k")).join(own, "k").select("id", "cpe")
    types = d.spark.createDataFrame([(1, True), (2, True), (3, False)], "id bigint, is_active boolean")
    links = d.table("labels").filter("doc_id % 24 = 4").select(doc.alias("component_id"), F.lit(3).cast("bigint").alias("correction_type_id"))
    return review.write_violations(requests, components, names, types, links, "s1")


def _write_sql(*rules):
    return over_domain("").rstrip() + ",\n" + _REQUESTS + "\n" + " union all ".join(f"select component_id, '{rule}' as rule from done where {_RULES[rule]}" for rule in rules)


_SOURCES = ("unknown_name", "two_sources", "invalid_manual", "other_snapshot")


@query("J08_review_sources", _write_sql(*_SOURCES))
def _(d):
    return _write_violations(d).filter(F.col("rule").isin(*_SOURCES))


_CHOICES = ("unknown_field", "repeated_type", "unknown_type", "inactive_type")


@query("J09_write_rules", _write_sql(*_CHOICES, "corrections_forbidden"))
def _(d):
    return _write_violations(d).filter(F.col("rule").isin(*_CHOICES, "corrections_forbidden"))


@query("L01_write_violations", _write_sql(*_RULES))
def _(d):
    return _write_violations(d)


@query("J09_forbidden_corrections", over_domain("select component_id, 'corrections_forbidden' as rule from outcomes where outcome in ('ORIGINAL_OFFICIAL_CONFIRMED', 'DIRECT_OFFICIAL_NOT_CONFIRMED') and component_id % 3 > 0"))
def _(d):
    reviews = d.reviews().withColumn("outcome", review.outcome(F.col("ground_truth_cpe"), F.col("original_cpe"), F.col("manual_ground_truth_cpe")))
    return review.review_violations(reviews.withColumn("n_corrections", F.col("component_id") % 3))


@query("J10_type_rules", """with t as (select s_suppkey id, case when s_suppkey % 5 = 0 then '9' else '' end || lower(replace(s_name, '#', '_')) as code, case when s_suppkey % 7 = 0 then ' ' when s_suppkey % 3 = 0 then s_mkt else s_name end as name from (select *, 'Shared ' || cast(s_suppkey % 4 as varchar) s_mkt from supplier))
select id, 'code' as rule from t where not regexp_full_match(lower(trim(code)), '[a-z][a-z0-9_]*') union all select id, 'blank_name' from t where trim(name) = '' union all
select id, 'repeated_name' from (select *, count(*) over (partition by lower(trim(name))) n from t) where n > 1 and trim(name) <> ''""")
def _(d):
    code = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "9").otherwise(""), F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("_"))))
    name = F.when(F.col("s_suppkey") % 7 == 0, " ").when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Shared "), (F.col("s_suppkey") % 4).cast("string"))).otherwise(F.col("s_name"))
    return review.type_violations(d.table("supplier").select(F.col("s_suppkey").alias("id"), code.alias("code"), name.alias("name"), F.lit("").alias("description")))


@query("A34_result_counts", over_domain("select count(*) total, count(*) filter (status = 'STRUCTURALLY_VALID') succeeded, count(*) filter (status <> 'STRUCTURALLY_VALID') failed, case when count(*) = 0 then 0.0 else (count(*) filter (status = 'STRUCTURALLY_VALID'))::double / count(*) end ratio from parsed where cpe <> ''"))
def _(d):
    return overview.result_counts(parse(matching.usage(d.components())), F.col("status") == "STRUCTURALLY_VALID")
