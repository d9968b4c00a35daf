"""Document fingerprints by a homomorphic multiset hash (native expressions only).

A text is a multiset of paragraphs (lines that are not empty). Every paragraph hashes to a wide
vector and the vectors are added lane by lane modulo a power of two, so that

* the order of paragraphs does not matter,
* a paragraph is inserted or deleted by adding or subtracting its vector (`combine`), and
* equal texts have equal fingerprints.

The vector has DENSE lanes modulo 2^32 from SHA-512 of the paragraph, which decide equality, and
LEVELS x SKETCH lanes modulo 2^16 for likeness: each sentence of the paragraph adds its hash to one
lane of level 0, every fourth sentence (by hash) also to level 1, every sixteenth to level 2, and so
on. The likeness of two vectors is the share of lanes in use that hold the same value, taken on the
first level sparse enough to tell sentences apart, or on the sparsest level in use where none is. The last level takes one
sentence in 4^11, so that it holds few sentences of the longest text a row can hold.

Defined cases: a null text is the empty text, whose vector is zero; two zero vectors are alike (1.0);
repeated rows and ties of the id are ordered by text; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DENSE = 16
SKETCH = 24
LEVELS = 12
#: A level is sparse enough when at most so many of its lanes are in use.
SPARSE = 16
#: Rows in a range of ids that one task orders, and the most ranges.
RANGE_ROWS, MAX_RANGES = 256, 16384
SENTENCE_END = r"(?<=[.!?])[ \t]+|\n"
_M16, _M32 = 0xFFFF, 0xFFFFFFFF


def _bind(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dense_lanes(text: Column) -> Column:
    """array<bigint> of DENSE sums modulo 2^32."""
    paragraphs = F.filter(F.split(text, "\n", -1), lambda p: p != "")

    def sums(digests: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(DENSE - 1)),
            lambda lane: F.aggregate(
                digests,
                F.lit(0).cast("bigint"),
                lambda acc, hexed: (acc + F.conv(F.substring(hexed, lane * 8 + 1, 8), 16, 10).cast("bigint")).bitwiseAND(F.lit(_M32).cast("bigint")),
            ),
        )

    return _bind(F.transform(paragraphs, lambda p: F.sha2(p, 512)), sums)


def sketch_lanes(text: Column) -> Column:
    """array<array<int>>: LEVELS arrays of SKETCH sums modulo 2^16."""
    sentences = F.filter(F.split(text, SENTENCE_END, -1), lambda s: s != "")

    def sums(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(SKETCH - 1)),
            lambda lane: F.aggregate(
                F.filter(hashes, lambda h: F.pmod(F.shiftright(h, 24).bitwiseAND(F.lit(0xFFFFF).cast("bigint")), F.lit(SKETCH)) == lane),
                F.lit(0),
                lambda acc, h: (acc + F.shiftrightunsigned(h, 48).cast("int")).bitwiseAND(F.lit(_M16)),
            ),
        )

    def levels(hashes: Column) -> Column:
        def at_level(k: int) -> Column:
            return F.filter(hashes, lambda h: h.bitwiseAND(F.lit(4**k - 1).cast("bigint")) == 0)

        kept = [hashes, *map(at_level, range(1, LEVELS))]
        return F.array(*[_bind(part, sums) for part in kept])

    return _bind(F.transform(sentences, lambda s: F.xxhash64(s)), levels)


def vector(text: Column) -> Column:
    """struct(dense array<bigint>, sketch array<array<int>>) of a text."""
    text = F.coalesce(text, F.lit(""))
    return _bind(text, lambda t: F.struct(dense_lanes(t).alias("dense"), sketch_lanes(t).alias("sketch")))


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The vector of both multisets together (sign 1) or of the difference (sign -1).

    Paragraphs are whole lines, so for texts a and b combine(vector(a), vector(b)) is the vector of a, a line break and b.
    """
    op = (lambda a, b: a + b) if sign > 0 else (lambda a, b: a - b)
    dense = F.zip_with(left["dense"], right["dense"], lambda a, b: op(a, b).bitwiseAND(F.lit(_M32).cast("bigint")))
    sketch = F.zip_with(left["sketch"], right["sketch"], lambda x, y: F.zip_with(x, y, lambda a, b: op(a, b).bitwiseAND(F.lit(_M16))))
    return F.struct(dense.alias("dense"), sketch.alias("sketch"))


def to_text(vec: Column) -> Column:
    """Lower-case hex: the dense lanes of 8 digits, then the sketch lanes of 4."""
    dense = F.array_join(F.transform(vec["dense"], lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")
    sketch = F.array_join(F.transform(F.flatten(vec["sketch"]), lambda v: F.lower(F.lpad(F.hex(v.cast("bigint")), 4, "0"))), "")
    return F.concat(dense, sketch)


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: the share of lanes in use, on the first sparse level, that agree; 1 for equal vectors."""

    def level(pair: Column) -> Column:
        def share(lanes: Column) -> Column:
            used = F.filter(lanes, lambda z: (z["a"] != 0) | (z["b"] != 0))
            return _bind(used, lambda u: F.struct(F.size(u).alias("n"), F.size(F.filter(u, lambda z: z["a"] == z["b"])).alias("same")))

        return share(F.zip_with(pair["x"], pair["y"], lambda a, b: F.struct(a.alias("a"), b.alias("b"))))

    levels = F.transform(F.zip_with(left["sketch"], right["sketch"], lambda x, y: F.struct(x.alias("x"), y.alias("y"))), level)

    def pick(all_levels: Column) -> Column:
        sparse = F.get(F.filter(all_levels, lambda s: (s["n"] > 0) & (s["n"] <= SPARSE)), F.lit(0))
        last = F.get(F.reverse(F.filter(all_levels, lambda s: s["n"] > 0)), F.lit(0))
        return F.coalesce(sparse, last)

    same = F.coalesce(_bind(pick(levels), lambda s: s["same"] / s["n"]), F.lit(0.0))
    return F.when(left["dense"] == right["dense"], F.lit(1.0)).otherwise(same)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, vec, fingerprint) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("vec", vector(F.col("text"))).withColumn("fingerprint", to_text(F.col("vec")))


def with_next(rows: DataFrame, key: str = "id", tie: str = "text") -> DataFrame:
    """Each row and, as struct `next`, the row that follows in descending order of key (after the last: the first).

    The ids are cut into ranges at approximate percentiles, which are ids that occur. A range is ordered by one task; the
    largest id of a range is the first row that follows the range above, so its rows are also sent there, marked as guests.
    """
    lowest = F.lit(-(2**63)).cast("bigint")
    ordered = rows.withColumn("_key", F.coalesce(F.col(key).cast("bigint"), lowest))
    ids = ordered.select("_key")
    total = ids.count()
    ranges = max(1, min(MAX_RANGES, -(-total // RANGE_ROWS)))
    shares = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx("_key", shares or [0.5], 10 * MAX_RANGES).alias("cut"), F.max("_key").alias("top")).first()
    cuts = sorted({*(found["cut"] or [] if shares else []), *([] if found["top"] is None else [found["top"]])})
    n = len(cuts)
    bounds = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    steps = [1 << b for b in reversed(range(max(1, n.bit_length())))]

    def below(target: Column) -> Column:
        """How many bounds are smaller than target, by binary search."""
        return F.aggregate(
            F.lit(steps),
            F.lit(0),
            lambda at, step: F.when((at + step <= n) & (F.get(bounds, at + step - 1) < target), at + step).otherwise(at),
        )

    placed = ordered.withColumn("_range", below(F.col("_key")))
    head = F.get(bounds, F.col("_range")) == F.col("_key")
    homes = F.when(head, F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("_range") + 1, F.lit(max(1, n))).alias("at"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest")))
    )
    # a head starts its own range and follows the rows of the range above
    sent = placed.withColumn("_home", F.explode(homes)).withColumn("_at", F.col("_home.at")).withColumn("_guest", F.col("_home.guest"))
    window = Window.partitionBy("_at").orderBy(F.col("_guest").asc(), F.col("_key").desc(), F.col(tie).asc())
    columns = [c for c in rows.columns]
    led = sent.withColumn("next", F.lead(F.struct(*columns)).over(window))
    return led.filter(~F.col("_guest")).select(*columns, "next")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/3) code points of text replaced by the first as many, or all, of the following text."""
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edits with the next document; the columns of the query's contract."""
    chained = with_next(fingerprints(docs, id_col, text_col))
    rows = chained.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("bigint").alias("n_chars"),
        "fingerprint",
        "vec",
        F.col("next.vec").alias("next_vec"),
        edited(F.col("text"), F.col("next.text")).alias("edited_text"),
    ).withColumn("edited_vec", vector(F.col("edited_text")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        to_text(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )
