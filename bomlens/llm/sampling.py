"""Bounded, reproducible samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.llm.common import crc_mod

_BUCKETS = 1_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """About per_class (text, label) rows of each label 0 and 1, never of held-out ids, in order of a hash of the id.

    per_class bounds the rows, and so the ids that are broadcast to the texts, and max_chars the characters that reach the driver; a text over max_chars is no sample. Rows
    are chosen by a threshold on a hash of the id, so no task sorts texts. Null ids or labels are left out.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.filter(crc_mod("id", divisor) != held_out).distinct()
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(label)), F.lit(_BUCKETS))
    counts = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    limits = {k: min(_BUCKETS, -(-_BUCKETS * per_class // n)) for k, n in counts.items()}
    limit = F.when(F.col("label") == 1, F.lit(limits.get(1, 0))).otherwise(F.lit(limits.get(0, 0)))
    chosen = known.withColumn("place", place).filter(F.col("place") < limit)
    texts = docs.select(F.col("doc_id").alias("id"), "text").filter(F.col("text").isNotNull() & (F.char_length("text") <= max_chars))
    rows = texts.join(F.broadcast(chosen), "id").select("place", "id", "text", "label").collect()
    rows.sort(key=lambda r: (r["place"], r["id"], r["text"]))
    return [(r["text"], r["label"]) for r in rows]
