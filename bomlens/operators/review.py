"""Review of components against the dictionary: queue, navigation, outcomes and write rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomlens.functions.cpe import FIELDS as ATTRIBUTES
from bomlens.functions.cpe import VALID, parsed
from bomlens.functions.text import CODE, has_hangul, normal_code, strip

CONFIRMED, CORRECTED, MANUAL, DIRECT = "ORIGINAL_OFFICIAL_CONFIRMED", "CORRECTED_TO_DICTIONARY", "MANUAL_FROM_OFFICIAL_FAMILY", "DIRECT_OFFICIAL_NOT_CONFIRMED"
OUTCOMES = (CONFIRMED, CORRECTED, MANUAL, DIRECT)
#: Fields that a request to write a review may give.
WRITE_FIELDS = ("dictionary_cpe_id", "manual_cpe", "correction_type_ids", "note")


def outcome(dictionary: Column, original: Column, manual: Column) -> Column:
    """How a review ended, from the chosen dictionary name, the original name and a name by hand."""
    return F.when(dictionary == original, CONFIRMED).when(dictionary.isNotNull(), CORRECTED).when(F.coalesce(manual, F.lit("")) != "", MANUAL).otherwise(DIRECT)


def allows_corrections(outcome_: Column) -> Column:
    return outcome_.isin(CORRECTED, MANUAL)


def source(dictionary: Column, manual: Column) -> Column:
    return F.when(dictionary.isNotNull(), "DICTIONARY").when(F.coalesce(manual, F.lit("")) != "", "MANUAL").otherwise("NONE")


def queue(components: DataFrame, reviews: DataFrame, status: str = "UNREVIEWED", outcomes: tuple[str, ...] = ()) -> DataFrame:
    """Components by review status (UNREVIEWED, COMPLETED, ALL; none for NOT_PRESENT), and of the completed those with some outcomes."""
    done = reviews.filter(F.col("outcome").isin(*outcomes)) if outcomes else reviews
    keys = done.select(F.col("component_id").alias("id")).distinct()
    if status == "NOT_PRESENT":  # a component without a name is never reviewed
        return components.filter(F.lit(False))
    if outcomes:
        return components.join(keys, "id", "left_semi") if status != "UNREVIEWED" else components.filter(F.lit(False))
    if status == "ALL":
        return components
    return components.join(keys, "id", "left_anti" if status == "UNREVIEWED" else "left_semi")


def neighbours(queue_: DataFrame, anchor: int, descending: bool = False) -> DataFrame:
    """One row: the ids before and after an anchor that need not be in the queue."""
    low, high = F.max(F.when(F.col("id") < anchor, F.col("id"))), F.min(F.when(F.col("id") > anchor, F.col("id")))
    before, after = (high, low) if descending else (low, high)
    return queue_.agg(before.alias("previous_id"), after.alias("next_id"))


def all_neighbours(queue_: DataFrame, partition: list[str], order: str) -> DataFrame:
    """Previous and next of every row inside its partition: the bulk form of neighbours."""
    by = Window.partitionBy(*partition).orderBy(order)
    return queue_.withColumns({"previous_id": F.lag(order).over(by), "next_id": F.lead(order).over(by)})


def review_violations(reviews: DataFrame) -> DataFrame:
    """(component_id, rule) of reviews with two sources, or with corrections where none are allowed."""
    both = F.col("ground_truth_cpe").isNotNull() & (F.coalesce("manual_ground_truth_cpe", F.lit("")) != "")
    forbidden = ~allows_corrections(F.col("outcome")) & (F.coalesce("n_corrections", F.lit(0)) > 0)
    rules = F.array_compact(F.array(F.when(both, "two_sources"), F.when(forbidden, "corrections_forbidden")))
    return reviews.select("component_id", F.explode(rules).alias("rule"))


def type_violations(types: DataFrame) -> DataFrame:
    """(id, rule) of correction types: code pattern, blank or repeated name, names not in English."""
    name = strip(F.col("name"))
    repeated = F.count("*").over(Window.partitionBy(F.lower(strip(F.col("name"))))) > 1
    rules = F.array_compact(
        F.array(
            F.when(~normal_code(F.col("code")).rlike(CODE), "code"),
            F.when(name == "", "blank_name"),
            F.when((name != "") & F.col("repeated"), "repeated_name"),
            F.when(has_hangul(F.concat_ws(" ", "name", "description")), "english_only"),
        )
    )
    return types.withColumn("repeated", repeated).select("id", F.explode(rules).alias("rule"))


def normal_types(types: DataFrame) -> DataFrame:
    """Correction types as they are kept: code in lower case, texts without space around them, active unless said otherwise."""
    active = F.coalesce("is_active", F.lit(True)) if "is_active" in types.columns else F.lit(True)
    return types.select("id", normal_code(F.col("code")).alias("code"), strip(F.col("name")).alias("name"), strip(F.coalesce("description", F.lit(""))).alias("description"), active.alias("is_active"))


def newly_inactive(chosen: DataFrame, types: DataFrame, links: DataFrame) -> DataFrame:
    """(component_id, correction_type_id) chosen now that are inactive and not chosen before."""
    inactive = types.filter(~F.col("is_active")).select(F.col("id").alias("correction_type_id"))
    return chosen.join(inactive, "correction_type_id", "left_semi").join(links, ["component_id", "correction_type_id"], "left_anti").select("component_id", "correction_type_id")


def foreign_names(requests: DataFrame, names: DataFrame, snapshot_id: str) -> DataFrame:
    """(component_id, dictionary_cpe_id) of requests whose dictionary name belongs to another snapshot."""
    other = names.filter(F.col("snapshot_id") != snapshot_id).select(F.col("id").alias("dictionary_cpe_id"))
    return requests.join(other, "dictionary_cpe_id", "left_semi").select("component_id", "dictionary_cpe_id")


def written(requests: DataFrame, components: DataFrame, names: DataFrame) -> DataFrame:
    """The reviews that requests (component_id, dictionary_cpe_id, manual_cpe) make: names, and how they ended."""
    known = names.select(F.col("id").alias("dictionary_cpe_id"), F.col("cpe_name").alias("ground_truth_cpe"))
    rows = requests.join(known, "dictionary_cpe_id", "left").join(components.select(F.col("id").alias("component_id"), F.col("cpe").alias("original_cpe")), "component_id", "left")
    rows = rows.withColumn("manual_ground_truth_cpe", strip(F.coalesce("manual_cpe", F.lit(""))))
    return rows.withColumn("outcome", outcome(F.col("ground_truth_cpe"), F.col("original_cpe"), F.col("manual_ground_truth_cpe")))


def write_violations(requests: DataFrame, components: DataFrame, names: DataFrame, types: DataFrame, links: DataFrame, snapshot_id: str) -> DataFrame:
    """(component_id, rule) of requests to write a review that break a rule; every broken rule is told.

    requests: component_id, dictionary_cpe_id, manual_cpe, correction_type_ids (array), given (names of the fields it gives);
    components: id, cpe; names: id, cpe_name, snapshot_id; types: id, is_active; links: component_id, correction_type_id.
    """
    ids = F.coalesce("correction_type_ids", F.array().cast("array<bigint>"))
    rows = written(requests, components, names).withColumns({"status": parsed(F.col("manual_ground_truth_cpe"))["status"], "ids": ids})
    manual = F.col("manual_ground_truth_cpe") != ""
    rules = [
        (F.size(F.array_except("given", F.array(*map(F.lit, WRITE_FIELDS)))) > 0, "unknown_field"),
        (F.size("ids") != F.size(F.array_distinct("ids")), "repeated_type"),
        (F.col("dictionary_cpe_id").isNotNull() & F.col("ground_truth_cpe").isNull(), "unknown_name"),
        (F.col("ground_truth_cpe").isNotNull() & manual, "two_sources"),
        (manual & (F.col("status") != VALID), "invalid_manual"),
        (~allows_corrections(F.col("outcome")) & (F.size("ids") > 0), "corrections_forbidden"),
    ]
    own = rows.select("component_id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))).alias("rule"))
    chosen = rows.select("component_id", F.explode(F.array_distinct("ids")).alias("correction_type_id"))
    unknown = chosen.join(types.select(F.col("id").alias("correction_type_id")), "correction_type_id", "left_anti")
    found = {"unknown_type": unknown, "inactive_type": newly_inactive(chosen, types, links.select("component_id", "correction_type_id")), "other_snapshot": foreign_names(requests, names, snapshot_id)}
    for name, violations in found.items():
        own = own.unionByName(violations.select("component_id", F.lit(name).alias("rule")))
    return own


def edit_signature(key: Column, types: Column) -> Column:
    """A digest of an edit that does not depend on the order in which types were chosen."""
    return F.sha2(F.to_json(F.struct(key.alias("key"), F.array_sort(types).alias("types"))), 256)
