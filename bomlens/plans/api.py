"""Entry points: the analyses and lists as functions that return frames."""

from __future__ import annotations

import json
import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.errors import EngineError
from bomlens.functions.cpe import parse, structural_fields
from bomlens.operators import checks, matching, mismatch, overview, profile, review, search
from bomlens.plans import sinks
from bomlens.plans.domain import Domain


def images_overview(d: Domain) -> DataFrame:
    return overview.image_overview(d.images(), d.sboms(), d.components())


def image_detail(d: Domain, image_id: int) -> DataFrame:
    return overview.sboms_of_images(d.images().filter(f"id = {search.positive(image_id)}"), d.sboms())


def sboms_list(d: Domain, page: int = 1, size: int | None = None) -> DataFrame:
    return search.existing_page(overview.newest_first(overview.sbom_overview(d.sboms(), d.components())), page, size)


def components_list(d: Domain, query: search.ComponentQuery, page: int = 1, size: int | None = None) -> DataFrame:
    """One page, joined with its exact matches after the limit; a page behind the last one is an error."""
    rows = search.existing_page(search.components_list(d.located(), d.names(), query), page, size)
    return matching.component_matches(rows, d.names())


def dictionary_search(d: Domain, query: search.DictionaryQuery) -> DataFrame:
    return search.dictionary_page(d.names(), query)


def cpe_profile(d: Domain, folder: str | None = None) -> dict[str, DataFrame]:
    """The frames of the profile report; written as one JSON and five CSV files when a folder is given."""
    located = d.located()
    parsed, counts = profile.parsed_components(located), profile.name_counts(located)
    summary = profile.image_summary(d.images(), counts)
    usage = profile.cpe_usage(parsed)
    frames = {
        "summary": profile.profile_summary(d.images(), counts), "image_summary": summary.orderBy("id"), "cpe_usage": usage.orderBy("cpe"),
        "invalid_cpes": profile.invalid_usage(usage).orderBy("cpe"), "vendor_product_summary": profile.vendor_products(parsed).orderBy("part", "vendor", "product"), "status_counts": profile.status_counts(parsed).orderBy("status"),
    }
    _report(frames, folder, overwrite=True)
    return frames


def exact_match_analysis(d: Domain, folder: str | None = None, overwrite: bool = False) -> dict[str, DataFrame]:
    counts = matching.match_counts(d.components(), d.names())
    frames = {"summary": counts.orderBy("match_status"), "unique": matching.exact_match(d.components(), d.names()).orderBy("cpe")}
    _report(frames, folder, overwrite)
    frames["components"] = matching.component_matches(d.components(), d.names())
    if folder:  # a row per component: written by the tasks
        sinks.write_csv(frames["components"], os.path.join(folder, "components.csv"), overwrite)
    return frames


def mismatch_analysis(d: Domain, folder: str | None = None, overwrite: bool = False) -> dict[str, DataFrame]:
    """The mismatch report; broken invariants raise before anything is written. The rows are worked out once and kept."""
    found = mismatch.mismatches(d.components(), d.names()).persist(StorageLevel.MEMORY_AND_DISK)
    checks.require_empty({"invariants": checks.mismatch_violations(found), "exact match": checks.exact_matches_inside(found, d.names()), "repeated": checks.duplicates(found, "cpe")})
    frames = {"summary": mismatch.profile_counts(found).orderBy("profile"), "rows": mismatch.report_order(found), "histograms": mismatch.field_histogram(found).orderBy("field", "value")}
    _report(frames, folder, overwrite)
    return frames


def _report(frames: dict[str, DataFrame], folder: str | None, overwrite: bool) -> None:
    if folder:
        texts = {f"{name}.csv": sinks.render_csv(df) for name, df in frames.items() if name != "summary"}
        sinks.write_report(folder, {"summary.json": sinks.summary_json({"rows": [r.asDict() for r in frames["summary"].collect()]})} | texts, overwrite)


def profile_text(d: Domain, folder: str | None = None) -> str:
    """The summary of the profile as JSON text, as a console shows it; with a folder the report is written as well."""
    frames = cpe_profile(d, folder)
    return json.dumps(frames["summary"].first().asDict(), indent=2, sort_keys=True, default=str)


def _one(rows: DataFrame, code: str) -> DataFrame:
    """rows, of which there must be some."""
    if not rows.limit(1).count():
        raise EngineError(code)
    return rows


def sbom_detail(d: Domain, sbom_id: int) -> DataFrame:
    """One document with its number of components."""
    own = search.positive(sbom_id)
    return _one(overview.sbom_overview(d.sboms().filter(F.col("id") == own), d.components().filter(F.col("sbom_document_id") == own)), "sbom_not_found")


def component_detail(d: Domain, component_id: int) -> DataFrame:
    """One component with its place, the status of its name and the fields of a valid one."""
    row = parse(_one(d.located().filter(F.col("id") == search.positive(component_id)), "component_not_found").withColumnRenamed("version", "component_version"))
    shown = row.withColumn("structural_fields", structural_fields(F.col("status"))).select(*[c for c in row.columns if c not in ("fields", *review.ATTRIBUTES)], "structural_fields")
    return matching.component_matches(shown, d.names())


def dictionary_detail(d: Domain, name_id: int) -> DataFrame:
    return _one(d.names().filter(F.col("id") == search.positive(name_id)), "cpe_name_not_found")


def review_queue(components: DataFrame, reviews: DataFrame, status: str = "UNREVIEWED", outcomes: tuple[str, ...] = (), descending: bool = False, page: int = 1, size: int | None = None) -> DataFrame:
    """A page of the queue in order of id."""
    rows = review.queue(components, reviews, status, outcomes)
    return search.existing_page(rows.orderBy(F.desc("id") if descending else F.asc("id")), page, size)


def navigate(components: DataFrame, reviews: DataFrame, anchor: int, status: str = "UNREVIEWED", outcomes: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    return review.neighbours(review.queue(components, reviews, status, outcomes), search.positive(anchor), descending)


def ground_truth(reviews: DataFrame, links: DataFrame, types: DataFrame, component_id: int) -> DataFrame:
    """The review of a component with its source, outcome and types; no row where there is none."""
    named = links.join(types.select(F.col("id").alias("correction_type_id"), "name"), "correction_type_id").withColumnRenamed("component_id", "ground_truth_id")
    row = reviews.filter(F.col("component_id") == search.positive(component_id))
    shown = row.withColumn("source", review.source(F.col("ground_truth_cpe"), F.col("manual_ground_truth_cpe")))
    return shown.join(overview.types_of_reviews(named), F.col("component_id") == F.col("ground_truth_id"), "left").drop("ground_truth_id")


def put_ground_truth(reviews: DataFrame, links: DataFrame, requests: DataFrame, components: DataFrame, names: DataFrame, types: DataFrame, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, links) after the requests: one row per component, and exactly the types that a request chose. Any broken rule refuses all."""
    checks.require_empty({"rules": review.write_violations(requests, components, names, types, links, snapshot_id)})
    written = review.written(requests, components, names)
    chosen = requests.select("component_id", F.explode_outer("correction_type_ids").alias("correction_type_id"))
    return sinks.upserted(reviews, written.select(*reviews.columns), ["component_id"]), sinks.replaced_links(links.select("component_id", "correction_type_id"), "component_id", chosen)


def correction_types(types: DataFrame, links: DataFrame, text: str = "", active: str = "true") -> DataFrame:
    """Types with the number of reviews that carry them, in order of their names whatever the case."""
    if active not in ("true", "false", "all"):
        raise EngineError("invalid_is_active", active)
    rows = types if active == "all" else types.filter(F.col("is_active") == (active == "true"))
    rows = rows.filter(search.any_contains_ci(text, "code", "name", "description")) if text else rows
    bridge = links.select("correction_type_id", F.col("component_id").alias("ground_truth_id"))
    return overview.type_usage(rows, bridge).orderBy(F.lower("name"), "id")


def create_correction_types(types: DataFrame, new: DataFrame) -> DataFrame:
    """types with the new ones, codes and names in normal form; any broken rule refuses all."""
    rows = review.normal_types(new)
    both = types.select("id", "code", "name", "description", "is_active").unionByName(rows)
    checks.require_empty({"rules": review.type_violations(both).join(rows.select("id"), "id", "left_semi"), "code": checks.duplicates(both, "code"), "id": checks.duplicates(both, "id")})
    return both


def patch_correction_type(types: DataFrame, type_id: int, changes: dict) -> DataFrame:
    """types with a changed description or is_active; code and name never change."""
    if fixed := sorted({"code", "name"} & set(changes)):
        raise EngineError("immutable_field", ", ".join(fixed))
    if unknown := sorted(set(changes) - {"description", "is_active"}):
        raise EngineError("unknown_field", ", ".join(unknown))
    own = F.col("id") == search.positive(type_id)
    _one(types.filter(own), "correction_type_not_found")
    out = types.withColumns({name: F.when(own, F.lit(value)).otherwise(F.col(name)) for name, value in changes.items()})
    checks.require_empty({"rules": review.type_violations(out).filter(own)})
    return out
