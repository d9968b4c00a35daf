"""List, search and page plans: validated parameters become lazy frames."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.errors import EngineError
from bomlens.functions.cpe import PARTS, present
from bomlens.functions.text import any_contains_ci, equals_ci
from bomlens.operators.matching import MATCH_STATUSES, not_in_dictionary, with_dictionary_row

DEFAULT_PAGE, LARGEST_PAGE = 50, 200
SEARCH_PAGES = (25, 50, 100)
COMPONENT_SEARCH = ("name", "version", "publisher", "purl", "cpe", "bom_ref")
DICTIONARY_SEARCH = ("cpe_name", "vendor", "product", "version", "titles")
#: Fields that a user may order components by, and the columns behind them.
ORDERINGS = {"name": "name", "version": "version", "cpe": "cpe", "component_type": "component_type", "repository": "repository", "tag": "tag", "id": "id"}


def positive(value, code: str = "invalid_number") -> int:
    """A positive whole number from a parameter."""
    text = str(value)
    if not text.isascii() or not text.isdigit() or int(text) < 1:
        raise EngineError(code, f"{value!r} is no positive whole number")
    return int(text)


@dataclass(frozen=True)
class ComponentQuery:
    """Parameters of the component list; None is 'not given'."""

    dictionary_status: str | None = None
    has_cpe: str | None = None
    image: int | None = None
    sbom: int | None = None
    search: str = ""
    ordering: str = ""

    def wanted_cpe(self) -> str:
        """true, false or all. Without a word it is true, but false for blank names; other combinations are refused."""
        if self.dictionary_status is not None and self.dictionary_status not in MATCH_STATUSES:
            raise EngineError("invalid_dictionary_status", self.dictionary_status)
        blank = self.dictionary_status == "NOT_PRESENT"
        wanted = self.has_cpe if self.has_cpe is not None else "false" if blank else "true"
        if wanted not in ("true", "false", "all"):
            raise EngineError("invalid_has_cpe", wanted)
        if self.dictionary_status is not None and ((blank and wanted == "true") or (not blank and wanted == "false")):
            raise EngineError("incompatible_component_filters")
        if self.image is not None and self.sbom is not None:
            raise EngineError("incompatible_component_filters", "image and sbom exclude each other")
        return wanted


def filter_has_cpe(components: DataFrame, wanted: str) -> DataFrame:
    if wanted == "all":
        return components
    return components.filter(present(F.col("cpe")) if wanted == "true" else ~present(F.col("cpe")))


def filter_status(components: DataFrame, names: DataFrame, status: str | None) -> DataFrame:
    """The four branches of the dictionary status: semi joins, an anti join, a filter."""
    if status is None:
        return components
    if status == "NOT_PRESENT":
        return components.filter(~present(F.col("cpe")))
    if status == "NOT_IN_DICTIONARY":
        return not_in_dictionary(components, names)
    return with_dictionary_row(components, names, status == "OFFICIAL_DEPRECATED")


def filter_scope(components: DataFrame, image: int | None = None, sbom: int | None = None) -> DataFrame:
    if image is not None:
        return components.filter(F.col("docker_image_id") == image)
    return components if sbom is None else components.filter(F.col("sbom_document_id") == sbom)


def search_components(components: DataFrame, search: str) -> DataFrame:
    return components.filter(any_contains_ci(search, *[c for c in COMPONENT_SEARCH if c in components.columns])) if search else components


def order_columns(ordering: str) -> list:
    """Columns of a comma list with `-` for descending; every unknown token is told. Nulls are last up, first down."""
    tokens = [t.strip() for t in ordering.split(",")]
    bad = [t for t in tokens if t.removeprefix("-") not in ORDERINGS]
    if bad:
        raise EngineError("invalid_ordering", ", ".join(bad))
    out = [F.desc_nulls_first(ORDERINGS[t[1:]]) if t.startswith("-") else F.asc_nulls_last(ORDERINGS[t]) for t in tokens]
    return [*out, F.asc("id")]


def default_order() -> list:
    return [F.asc_nulls_last("repository"), F.asc_nulls_last("tag"), F.asc("name"), F.asc("version"), F.asc("id")]


def components_list(located: DataFrame, names: DataFrame, query: ComponentQuery) -> DataFrame:
    """The component list without paging; parameters are checked in the order in which errors win."""
    wanted = query.wanted_cpe()
    rows = filter_has_cpe(filter_status(located, names, query.dictionary_status), wanted)
    rows = search_components(filter_scope(rows, query.image, query.sbom), query.search)
    return rows.orderBy(*(order_columns(query.ordering) if query.ordering else default_order()))


def page_size(value=None, largest: int = LARGEST_PAGE) -> int:
    return DEFAULT_PAGE if value is None else min(largest, positive(value, "invalid_page_size"))


def page(rows: DataFrame, number=1, size=None) -> DataFrame:
    """One page of ordered rows; later joins touch this page only."""
    size = page_size(size)
    return rows.offset((positive(number, "invalid_page") - 1) * size).limit(size)


def existing_page(rows: DataFrame, number=1, size=None) -> DataFrame:
    """The same, but a page behind the last one is an error; the first page of nothing is empty."""
    found = page(rows, number, size)
    if positive(number, "invalid_page") > 1 and not found.limit(1).count():
        raise EngineError("invalid_page", str(number))
    return found


def envelope(rows: DataFrame, number: int = 1, size: int | None = None) -> DataFrame:
    """(count, page, page_size, total_pages, next_page, previous_page); an empty result has one page."""
    size = page_size(size)
    total = F.greatest(F.lit(1), F.ceil(F.col("count") / size)).cast("int")
    out = rows.agg(F.count("*").alias("count")).select("count", F.lit(number).alias("page"), F.lit(size).alias("page_size"), total.alias("total_pages"))
    checked = F.when(F.col("page") > F.col("total_pages"), F.raise_error(F.lit("invalid_page")).cast("int")).otherwise(F.col("page"))
    return out.select("count", checked.alias("page"), "page_size", "total_pages", F.when(F.col("page") < F.col("total_pages"), F.col("page") + 1).alias("next_page"), F.when(F.col("page") > 1, F.col("page") - 1).alias("previous_page"))


def plain_pages(count: int, size: int) -> int:
    """Pages of the dictionary search: none when nothing is found."""
    return math.ceil(count / size)


@dataclass(frozen=True)
class DictionaryQuery:
    """Parameters of the dictionary search."""

    q: str = ""
    part: str = ""
    vendor: str = ""
    product: str = ""
    version: str = ""
    cpe_name: str = ""
    deprecated: str = "active"
    page: int = 1
    size: int = 25

    def validated(self) -> DictionaryQuery:
        if self.q and len(self.q.strip()) < 2:
            raise EngineError("cpe_search_query_too_short")
        if self.part and self.part not in PARTS:
            raise EngineError("invalid_part", self.part)
        if self.deprecated not in ("all", "active", "deprecated"):
            raise EngineError("invalid_deprecated", self.deprecated)
        if self.size not in SEARCH_PAGES:
            raise EngineError("invalid_page_size", str(self.size))
        positive(self.page, "invalid_page")
        if not (self.q or self.vendor or self.product or self.version or self.cpe_name):
            raise EngineError("cpe_search_term_required")
        return self


def filter_deprecated(names: DataFrame, which: str) -> DataFrame:
    return names if which == "all" else names.filter(F.col("deprecated") == (which == "deprecated"))


def dictionary_order() -> list:
    return [F.asc(c) for c in ("deprecated", "vendor", "product", "version", "cpe_name")]


def dictionary_search(names: DataFrame, query: DictionaryQuery) -> DataFrame:
    """Matching names in their total order, without paging."""
    query = query.validated()
    rows = filter_deprecated(names, query.deprecated)
    if query.part:
        rows = rows.filter(F.col("part") == query.part)
    for field in ("vendor", "product", "version"):
        if getattr(query, field):
            rows = rows.filter(equals_ci(F.col(field), getattr(query, field)))
    if query.cpe_name:
        rows = rows.filter(F.col("cpe_name") == query.cpe_name)
    if query.q:
        rows = rows.filter(any_contains_ci(query.q.strip(), *[c for c in DICTIONARY_SEARCH if c in names.columns]))
    return rows.orderBy(*dictionary_order())


def dictionary_page(names: DataFrame, query: DictionaryQuery) -> DataFrame:
    """A page of the search; a page beyond the end is empty."""
    return dictionary_search(names, query).offset((query.page - 1) * query.size).limit(query.size)


def select_snapshot(snapshots: DataFrame, snapshot_id: str | None = None) -> str:
    """The id of the one complete snapshot; never a guess among several."""
    rows = snapshots if snapshot_id is None else snapshots.filter(F.col("snapshot_id") == snapshot_id)
    found = rows.filter(F.col("status") == "COMPLETE").select("snapshot_id").limit(2).collect()
    if not found:
        raise EngineError("cpe_dictionary_snapshot_unavailable")
    if len(found) > 1:
        raise EngineError("cpe_dictionary_snapshot_ambiguous")
    return found[0]["snapshot_id"]
