"""Scalar functions on names, paths, references and dates, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL = r"[ᄀ-ᇿ㄰-㆏ꥠ-꥿가-퟿ﾠ-ￜ]"
CODE = r"\A[a-z][a-z0-9_]*\z"
SHA256 = r"\A[0-9a-f]{64}\z"
DIGEST = r"\Asha256:[0-9a-f]{64}\z"
DEFAULT_REGISTRY, DEFAULT_NAMESPACE, DEFAULT_TAG = "docker.io", "library", "latest"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def has_hangul(text: Column) -> Column:
    return text.rlike(HANGUL)


def normal_code(text: Column) -> Column:
    return F.lower(strip(text))


def is_code(text: Column) -> Column:
    return normal_code(text).rlike(CODE)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def upload_basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def is_safe_filename(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z0-9._-]+\z") & ~text.isin(".", "..")


def sbom_filename(repository: Column, tag: Column) -> Column:
    return F.concat(safe_filename(basename(repository)), F.lit("-"), safe_filename(tag), F.lit(".cdx.json"))


def content_path(sha: Column) -> Column:
    return F.concat(F.lit("sboms/"), F.substring(sha, F.lit(1), F.lit(2)), F.lit("/"), sha, F.lit(".json"))


def title_words(code: Column) -> Column:
    return F.initcap(F.replace(F.lower(code), F.lit("_"), F.lit(" ")))


def contains_ci(column: Column, query: str | Column) -> Column:
    """Case-insensitive literal substring; null holds nothing."""
    needle = F.lit(query) if isinstance(query, str) else query
    return F.coalesce(F.contains(F.lower(column), F.lower(needle)), F.lit(False))


def any_contains_ci(query: str, *columns: str) -> Column:
    out = F.lit(False)
    for column in columns:
        out = out | contains_ci(F.col(column), query)
    return out


def equals_ci(column: Column, value: str) -> Column:
    return F.lower(column) == F.lower(F.lit(value))


def image_reference(reference: Column) -> Column:
    """struct(registry, repository, tag) of `[registry/]path[:tag]`, with the defaults of the public registry."""
    head = F.split(reference, "/")[0]
    has_registry = F.contains(reference, F.lit("/")) & (F.contains(head, F.lit(".")) | F.contains(head, F.lit(":")) | (head == "localhost"))
    rest = F.when(has_registry, F.substring(reference, F.char_length(head) + 2, F.char_length(reference))).otherwise(reference)
    last = F.element_at(F.split(rest, "/"), -1)
    tagged = F.contains(last, F.lit(":"))
    tag = F.when(tagged, F.element_at(F.split(last, ":"), -1)).otherwise(DEFAULT_TAG)
    path = F.when(tagged, F.substring(rest, F.lit(1), F.char_length(rest) - F.char_length(tag) - 1)).otherwise(rest)
    registry = F.when(has_registry, F.when(head.isin("index.docker.io", "registry-1.docker.io"), DEFAULT_REGISTRY).otherwise(head)).otherwise(DEFAULT_REGISTRY)
    path = F.when((registry == DEFAULT_REGISTRY) & ~F.contains(path, F.lit("/")), F.concat(F.lit(DEFAULT_NAMESPACE + "/"), path)).otherwise(path)
    return F.struct(registry.alias("registry"), F.concat(registry, F.lit("/"), path).alias("repository"), tag.alias("tag"))


def display_identity(manufacturer, product, version, repository, tag, generator, generator_version, filename, sha) -> Column:
    """The first that is not blank: names, image with generator, file name, short hash."""
    names = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (manufacturer, product, version)])
    image = F.when(repository.isNotNull(), F.concat(repository, F.lit(":"), tag, F.lit(" - "), generator, F.lit(" "), generator_version))
    return F.coalesce(F.nullif(names, F.lit("")), image, F.nullif(filename, F.lit("")), F.concat(F.lit("SBOM "), F.substring(sha, F.lit(1), F.lit(12))))


def aware_timestamp(text: Column) -> Column:
    """A timestamp with an offset; null for anything else."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})\z"), F.try_to_timestamp(text))


def utc_timestamp(text: Column) -> Column:
    """A timestamp; without an offset it counts as UTC (the session's zone)."""
    return F.try_to_timestamp(text)


def render_utc(moment: Column, millis: bool = True) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'" if millis else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snapshot_id(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'")


def canonical_uuid(text: Column) -> Column:
    """Lower-case dashed form of the usual spellings; null when it is none."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(text, r"\A(urn:)?(uuid:)?", ""), r"[{}-]", ""))
    return F.when(bare.rlike(r"\A[0-9a-f]{32}\z"), F.regexp_replace(bare, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5"))


def page_window(page: Column, total: Column, width: int = 5) -> Column:
    """The numbers of up to `width` pages around page, moved inside 1..total."""
    first = F.greatest(F.lit(1), F.least(page - width // 2, total - width + 1))
    last = F.least(total, first + width - 1)
    return F.when(total >= 1, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


#: Parts of the names of properties that help to tell where a component comes from.
RELEVANT_TERMS = ("source", "upstream", "package", "manager", "type", "ecosystem", "foundby", "cpe", "location", "path")


def relevant_properties(properties: Column, terms: tuple[str, ...] = RELEVANT_TERMS) -> Column:
    """The entries of array<struct(key, value)> whose key holds one of the terms, whatever its case."""
    wanted = F.array(*map(F.lit, terms))
    return F.filter(properties, lambda p: F.exists(wanted, lambda t: F.contains(F.lower(p["key"]), t)))


def candidate_values(properties: Column, key: str, primary: Column) -> Column:
    """array<struct(value, is_primary)> of the entries with a key; is_primary where the value is the component's own name."""
    return F.transform(F.filter(properties, lambda p: p["key"] == key), lambda p: F.struct(p["value"].alias("value"), (p["value"] == primary).alias("is_primary")))


def percent(ratio: Column) -> Column:
    """A share as a percentage with one digit, kept between 0 and 100."""
    return F.concat(F.format_number(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ratio * 100)), 1), F.lit("%"))
