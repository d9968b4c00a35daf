"""Integrity checks as frames of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.errors import IntegrityError
from bomlens.operators.mismatch import KEYS, profile_of


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def missing_and_extra(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, by a full outer join of distinct keys."""
    left = expected.select(key).distinct().withColumn("in_expected", F.lit(True))
    right = found.select(key).distinct().withColumn("in_found", F.lit(True))
    joined = left.join(right, key, "full_outer")
    return joined.filter(F.col("in_expected").isNull() | F.col("in_found").isNull()).select(key, F.when(F.col("in_found").isNull(), "missing").otherwise("extra").alias("side"))


def metadata_mismatches(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of the same key whose fields differ, with the names of those fields."""
    other = incoming.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    differing = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]))
    return existing.join(other, key).select(key, differing.alias("differing")).filter(F.size("differing") > 0)


def match_identities(counts: DataFrame, components: int | None = None) -> DataFrame:
    """One row of booleans over match_counts."""
    def of(status: str, column: str):
        return F.sum(F.when(F.col("match_status") == status, F.col(column)).otherwise(0))

    return counts.agg(
        (F.count("*") == 4).alias("four_statuses"),
        (of("NOT_PRESENT", "unique_cpes") == 0).alias("blank_is_no_name"),
        (F.min("components") >= 0).alias("no_negative"),
        (F.count_if(F.col("components") < F.col("unique_cpes")) == 0).alias("components_cover_names"),
        (F.count_if((F.col("unique_cpes") == 0) & (F.col("components") > 0) & (F.col("match_status") != "NOT_PRESENT")) == 0).alias("names_behind_components"),
    )


def mismatch_violations(found: DataFrame) -> DataFrame:
    """(cpe, rule) of mismatch rows that break an invariant."""
    rules = []
    for level in KEYS:
        rules.append(F.when(F.col(f"{level}_total") != F.col(f"{level}_active") + F.col(f"{level}_deprecated"), f"{level}_total"))
    rules.append(F.when((F.col("four_total") > F.col("three_total")) | (F.col("three_total") > F.col("two_total")), "levels"))
    rules.append(F.when(F.col("profile") != profile_of(F.col("status"), F.col("four_total"), F.col("three_total"), F.col("two_total")), "profile"))
    rules.append(F.when(F.col("component_count") < 1, "component_count"))
    return found.select("cpe", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def exact_matches_inside(found: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of a mismatch population that the dictionary does hold; there must be none."""
    return found.join(names.select(F.col("cpe_name").alias("cpe")), "cpe", "left_semi").select("cpe")


def missing_keys(present, required: tuple[str, ...]):
    """The required keys that an array of keys lacks."""
    return F.array_except(F.array(*map(F.lit, required)), present)


def require_empty(checks: dict[str, DataFrame], examples: int = 3) -> None:
    """Raise one IntegrityError that names every check with violations; one job for all of them."""
    tagged = [df.select(F.lit(name).alias("check"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in checks.items()]
    if not tagged:
        return
    rows = reduce(DataFrame.unionByName, tagged).groupBy("check").agg(F.count("*").alias("n"), F.min("row").alias("example")).orderBy("check").collect()
    if rows:
        raise IntegrityError("integrity", "; ".join(f"{r['check']}: {r['n']} rows, as {r['example']}" for r in rows))
