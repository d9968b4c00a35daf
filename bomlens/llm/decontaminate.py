"""Benchmark decontamination by spaced-seed hashing.

A mask names the words of a stretch that are hashed; the others may be anything, so a substituted word costs only the
masks that look at it. Hashes of benchmark items and of documents meet in an equi-join. A hit fixes a diagonal, the offset
of the item inside the document, and the words along it are compared one by one: the best stretch, scored +1 for an equal
word and -MISS for another, is an overlap when it holds enough equal words at a high enough rate.

Words are lower-cased (A-Z), split at ASCII white space and stripped of punctuation around them. Masks look at the fewer words
the shorter the item is, so that the substitutions that an overlap may have leave some mask whole. An item under WHOLE words is
also an overlap when LEAST_RATE of its words, rounded up, are equal anywhere along the diagonal. An item under SHORTEST words
is an overlap only of a document that has the same words and no others.

Documents that have none of the benchmark's hashes are passed over by a bit table of fixed size; it only saves work,
the join decides. Seeds are joined under a salt, so one passage in very many documents is dealt out.

Defined cases: null and empty texts and items match nothing; repeated rows give repeated results; equal items each match; of
an item's overlaps in a text the one with the most equal words is given, of those the shortest; a text of any length is
compared whole; empty tables give no rows; extra columns, whatever their names, are ignored or, where rows are returned, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.llm.common import free_name, stored, tidied, with_row_id, without_keys
from bomlens.llm.shingles import REMEMBERED, mix, words

#: The masks; 1 is a word that is hashed.
MASKS = ("1110110111", "1101011011", "1011101101")
WIDE_MASKS = ("1101011", "1110011", "10110101")
MIDDLE_MASKS = ("11101", "100111")
SHORT_MASKS = ("111", "1101", "1011")
WHOLE_MASKS = ("1", "11", "111")
ALL_MASKS = (*MASKS, *MIDDLE_MASKS, *SHORT_MASKS, *WIDE_MASKS, *WHOLE_MASKS)
#: The least words of items that use the short, the middle, the wide and the long masks, and of those without the whole-item rule.
SHORTEST, MIDDLE, WIDE, LONG, WHOLE = 4, 12, 18, 28, 18
MISS, LEAST_EQUAL, LEAST_RATE = 2, 13, 0.75
TABLE_BITS = 1 << 23
PROBES = (0, 20, 40)
SALTS = 8
EDGE = b".,!?;:\"'()[]{}"


class StrippedHashes(dict):
    """The 64-bit hash of a word without punctuation around it; forgets all when it holds REMEMBERED words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.strip(EDGE) or word)
        return value


def word_codes(text: bytes | None, known: StrippedHashes) -> np.ndarray:
    tokens = words(text)
    return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def seeds(codes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of the mask's words at every position that has room for it."""
    n = len(codes) - len(mask) + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, number + 1, dtype=np.uint64)
    for at, used in enumerate(mask):
        if used == "1":
            total = (total ^ codes[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return mix(total)


def item_masks(length: int) -> list[tuple[int, str]]:
    """(number, mask) of the masks for an item of so many words."""
    first = len(ALL_MASKS) - len(WHOLE_MASKS)
    if length < SHORTEST:
        return [(first + length - 1, WHOLE_MASKS[length - 1])] if length else []
    group = MASKS if length >= LONG else WIDE_MASKS if length >= WIDE else MIDDLE_MASKS if length >= MIDDLE else SHORT_MASKS
    return [(number, mask) for number, mask in enumerate(ALL_MASKS[:first]) if mask in group]


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """(equal words, words) of the stretch with the highest score along a diagonal."""
    totals = np.r_[0, np.cumsum(np.where(equal, 1, -MISS))]
    low = np.minimum.accumulate(totals)
    end = int(np.argmax(totals - low))
    start = int(np.flatnonzero(totals[: end + 1] == low[end])[-1]) if end else 0
    return int(equal[start:end].sum()), end - start


def overlap(same: np.ndarray, item_length: int) -> tuple[int, int] | None:
    """(equal words, words) of the overlap along a diagonal, None where there is none."""
    if item_length < SHORTEST:
        return (item_length, item_length) if len(same) == item_length and same.all() else None
    equal, length = best_stretch(same)
    if equal >= min(LEAST_EQUAL, item_length) and equal >= LEAST_RATE * length:
        return equal, length
    whole = int(same.sum())
    return (whole, len(same)) if item_length < WHOLE and whole >= LEAST_RATE * item_length else None


def item_seeds(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, codes, hashes, places): an item's words and its seeds with their positions."""

    def run(batches):
        known = StrippedHashes()
        for batch in batches:
            ids, codes, hashes, places = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = word_codes(text.as_py(), known)
                rows = [seeds(found, mask, number) for number, mask in item_masks(len(found))]
                ids.append(item)
                codes.append(found.view(np.int64))
                hashes.append(np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64))
                places.append(np.concatenate([np.arange(len(r)) for r in rows]) if rows else np.empty(0, np.int64))
            arrays = [pa.array(ids, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (codes, hashes, places))]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "codes", "hashes", "places"])

    rows = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "item_id bigint, codes array<bigint>, hashes array<bigint>, places array<bigint>")


def bit_table(hashes: DataFrame) -> np.ndarray:
    """TABLE_BITS flags, PROBES of them set for every seed of the benchmark; gathered as distinct bit numbers."""
    table = np.zeros(TABLE_BITS, dtype=bool)
    places = F.array(*[F.pmod(F.shiftrightunsigned("hash", shift), F.lit(TABLE_BITS)) for shift in PROBES])
    bits = hashes.select(F.explode(places).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)
    table[bits] = True
    return table


def in_table(found: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Positions of the seeds all of whose flags are set."""
    at = np.flatnonzero(flags[(found & np.uint64(TABLE_BITS - 1)).astype(np.int64)])
    for shift in PROBES[1:]:
        at = at[flags[((found[at] >> np.uint64(shift)) & np.uint64(TABLE_BITS - 1)).astype(np.int64)]]
    return at


def hit_documents(docs: DataFrame, table: np.ndarray, masks: list[tuple[int, str]]) -> DataFrame:
    """(key, id, codes, hashes, places) of documents (key, id, text) with seeds of the masks in the table."""
    shared, whole = docs.sparkSession.sparkContext.broadcast(table), len(ALL_MASKS) - len(WHOLE_MASKS)

    def run(batches):
        known, flags = StrippedHashes(), shared.value
        for batch in batches:
            rows, kept = [], []
            for n, text in enumerate(batch.column(2).cast(pa.binary())):
                codes = word_codes(text.as_py(), known)
                hashes, places = [], []
                for number, mask in masks:
                    if number >= whole and len(codes) != len(mask):
                        continue
                    found = seeds(codes, mask, number)
                    at = in_table(found, flags)
                    if len(at):
                        hashes.append(found[at])
                        places.append(at)
                if hashes:
                    kept.append(n)
                    rows.append((codes.view(np.int64), np.concatenate(hashes).view(np.int64), np.concatenate(places)))
            if kept:
                at = pa.array(kept)
                lists = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *lists], names=["key", "id", "codes", "hashes", "places"])

    return docs.select("key", "id", "text").mapInArrow(tidied(run), "key bigint, id bigint, codes array<bigint>, hashes array<bigint>, places array<bigint>")


def _pairs(rows: DataFrame, *own: str) -> DataFrame:
    return rows.select(*own, F.explode(F.arrays_zip("hashes", "places")).alias("seed")).select(*own, F.col("seed.hashes").alias("hash"), F.col("seed.places").alias("place"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(key, doc_id, item_id, n_equal, n_words): each document's best verified overlap with each item; key numbers the row."""
    items = stored(item_seeds(benchmark, item_col, item_text_col).filter(F.size("hashes") > 0), "items")
    numbered = with_row_id(items, "item")
    numbered = stored(numbered, "items")
    marks = _pairs(numbered, "item")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    lengths = numbered.select(F.least(F.size("codes"), F.lit(LONG)).alias("n")).distinct().collect()
    masks = sorted({mask for row in lengths for mask in item_masks(row["n"])})
    hit = stored(hit_documents(with_row_id(rows, "key"), bit_table(marks), masks), "hits")
    return verified(hit, numbered, marks)


def verified(hit: DataFrame, items: DataFrame, marks: DataFrame) -> DataFrame:
    salted = marks.withColumnRenamed("place", "item_place").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = _pairs(hit, "key").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    diagonals = found.select("key", "item", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    by_item = diagonals.groupBy("key", "item").agg(F.collect_list("diagonal").alias("diagonals")).join(items.select("item", "item_id", F.col("codes").alias("item_codes")), "item")
    beside = by_item.groupBy("key").agg(F.collect_list(F.struct("item_id", "diagonals", "item_codes")).alias("found"))

    def run(batches):
        for batch in batches:
            out = []
            for key, doc, codes, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words_ = np.array(codes, np.int64)
                for item in places:
                    item_codes, best = np.array(item["item_codes"], np.int64), None
                    if len(item_codes) < SHORTEST and len(words_) != len(item_codes):
                        continue
                    for diagonal in item["diagonals"]:
                        start, end = max(0, diagonal), min(len(words_), diagonal + len(item_codes))
                        found_ = overlap(words_[start:end] == item_codes[start - diagonal : end - diagonal], len(item_codes))
                        if found_ and (best is None or (found_[0], -found_[1]) > best):
                            best = found_[0], -found_[1]
                    if best:
                        out.append((key, doc, item["item_id"], best[0], -best[1]))
            arrays = [pa.array([o[k] for o in out], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "item_id", "n_equal", "n_words"])

    joined = hit.select("key", "id", "codes").join(beside, "key")
    return joined.mapInArrow(tidied(run), "key bigint, doc_id bigint, item_id bigint, n_equal bigint, n_words bigint")


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, item_id, n_equal, n_words) of every overlap."""
    return overlaps(docs, benchmark, **columns).drop("key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text overlaps an item; equal rows share their fate."""
    name = free_name(docs, "_mark")
    marked = docs.withColumn(name, F.xxhash64(F.col(id_col), F.col(text_col)))
    bad = overlaps(marked.select(F.col(name).alias("mark"), F.col(text_col).alias("text")), benchmark, id_col="mark").select(F.col("doc_id").alias(name))
    return without_keys(marked, bad, name).select(*docs.columns)
