"""Structured product names: parsing and derived columns, as native expressions.

A name is `cpe:2.3:` and eleven fields parted by colons; a backslash takes the next character literally. Checks run in a
fixed order: prefix, dangling backslash, number of fields, part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format.
PREFIX = "cpe:2.3:"
FIELDS = ("part", "vendor", "product", "version", "update", "edition", "language", "sw_edition", "target_sw", "target_hw", "other")
PARTS = ("a", "o", "h")
VALID, BAD_PREFIX, BAD_COUNT, BAD_ESCAPE, BAD_PART = "STRUCTURALLY_VALID", "INVALID_PREFIX", "INVALID_FIELD_COUNT", "INVALID_ESCAPE", "INVALID_PART"
STATUSES = (VALID, BAD_PREFIX, BAD_COUNT, BAD_ESCAPE, BAD_PART)
ABSENT = "NOT_PRESENT"
VERSION_KINDS = ("wildcard", "NA", "explicit")
_FIELD = r"(?s)((?:[^\\:]|\\.)*+):"
_WHOLE = r"(?s)\A(?:[^\\]|\\.)*+\z"


def body(cpe: Column) -> Column:
    return F.substring(cpe, F.lit(len(PREFIX) + 1), F.char_length(cpe))


def raw_fields(cpe: Column) -> Column:
    """All fields as written; for a name with the prefix and no dangling backslash."""
    return F.regexp_extract_all(F.concat(body(cpe), F.lit(":")), F.lit(_FIELD), F.lit(1))


def status(cpe: Column, fields: Column) -> Column:
    """Structural status; null counts as a name without the prefix."""
    return (
        F.when(~F.coalesce(F.startswith(cpe, F.lit(PREFIX)), F.lit(False)), BAD_PREFIX)
        .when(~body(cpe).rlike(_WHOLE), BAD_ESCAPE)
        .when(F.size(fields) != len(FIELDS), BAD_COUNT)
        .when(~F.get(fields, F.lit(0)).isin(*PARTS), BAD_PART)
        .otherwise(VALID)
    )


def python_repr(text: Column) -> Column:
    """Quoted as Python does for printable text: single quotes unless the text holds one and no double quote."""
    single = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    escaped = F.replace(F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.when(single, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def message(status_: Column, fields: Column) -> Column:
    """Why a name is invalid; '' for a valid one."""
    return (
        F.when(status_ == BAD_PREFIX, F.lit("name must start with cpe:2.3:"))
        .when(status_ == BAD_ESCAPE, F.lit("name ends in a dangling escape"))
        .when(status_ == BAD_COUNT, F.concat(F.lit("expected 11 fields, found "), F.size(fields).cast("string")))
        .when(status_ == BAD_PART, F.concat(F.lit("part must be a, o or h, found "), python_repr(F.get(fields, F.lit(0)))))
        .otherwise("")
    )


def bind(value: Column, of) -> Column:
    """of(value) with value worked out once, however often it is used; nothing is inlined into what follows."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def parsed(cpe: Column) -> Column:
    """struct(fields, status, the eleven attributes) of a name; attributes are '' unless it is valid."""

    def attributes(fields: Column, status_: Column) -> Column:
        found = [F.when(status_ == VALID, F.get(fields, F.lit(k))).otherwise("").alias(f) for k, f in enumerate(FIELDS)]
        return F.struct(fields.alias("fields"), status_.alias("status"), *found)

    def whole(name: Column) -> Column:
        fields = F.when(F.startswith(name, F.lit(PREFIX)) & body(name).rlike(_WHOLE), raw_fields(name))
        return bind(fields, lambda f: bind(status(name, f), lambda s: attributes(f, s)))

    return bind(cpe, whole)


def parse(df, column: str = "cpe"):
    """df with `status`, `fields` (array) and the eleven attributes, which are '' unless the name is valid."""
    out, found = df.withColumn("_parsed", parsed(F.col(column))), F.col("_parsed")
    return out.withColumns({f: found[f] for f in ("fields", "status", *FIELDS)}).drop("_parsed")


def version_kind(version: Column) -> Column:
    return F.when(version == "*", "wildcard").when(version == "-", "NA").otherwise("explicit")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / F.when(denominator != 0, denominator))


def joined_distinct(column: Column) -> Column:
    """Distinct values in code-point order, joined by a bar (an aggregate)."""
    return F.array_join(F.array_sort(F.collect_set(column)), "|")


def present(cpe: Column) -> Column:
    return F.coalesce(cpe, F.lit("")) != ""


def structural_fields(status_: Column, *columns: str) -> Column:
    """A struct of the attributes, null unless valid."""
    return F.when(status_ == VALID, F.struct(*(columns or FIELDS)))
