"""Language-model scoring of whole documents with the gated recurrent model of `gru`, beside a smoothed unigram base.

Tokens are the words of a text with A-Z in lower case, split at ASCII white space, and one end. Every training document
is counted. The most frequent tokens are learned outputs of the model; any other word belongs to one of the model's tail
classes, named by its first and last bytes, and is drawn inside it in proportion to its smoothed count. Each tail class sets
aside the smoothing of one unknown word, as the base does once.

Up to HOT of the most frequent words are published for the workers to read (a bounded table). The words beyond them join
the table of counts by key and add up per document, so no worker needs the vocabulary. All training documents train the
model, whole and each once: those that a hash of the text deals to the first of two rounds, then the others. In a round every
task reads its partition from the same parameters on, and Spark averages what the tasks have learned, weighted by tokens;
the second round starts from that average. Texts are read where they lie, none is shuffled. Both grow with the corpus.

Words are keyed by 64-bit hashes. Defined cases: a null text is empty and has the end token alone; a null id is no
held-out row; repeated rows, and ties of any kind, are scored, and counted, once each; a text of any length is read whole,
with its state carried from window to window; extra columns, whatever their names, are ignored; without training documents
every token is unknown; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.llm import gru
from bomlens.llm.common import crc_mod, most_frequent, published, read_published, slices, stored, tidied, with_row_id

HELD_OUT = (10, 0)
SMOOTHING = 0.1
HOT = 524_288
#: One text in so many, by its hash, is read in the first round; documents whose tasks' parameters are added up together.
FIRST_SHARE, MERGED_DOCS = 8, 2000
#: Words counted by a worker at once, and bytes of texts taken together.
COUNTED, TOGETHER = 500_000, 6_000_000
#: Bytes up to which a worker keeps freed blocks while it runs the network.
HELD = 1 << 26
LN10 = math.log(10)


class Tokens:
    """The tokens of some texts: distinct words, their keys and tail classes, and per token the number of its word.

    The end token, after the words of each text, has the number behind the last word. bounds are the texts' first tokens.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(texts)))
        coded = lists.flatten().dictionary_encode()
        self.words = coded.dictionary
        number, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        blank = pc.index(self.words, "").as_py()  # a blank text is split into one empty word
        if blank >= 0:
            number, owner = number[number != blank], owner[number != blank]
        self.end = len(self.words)
        counts = np.bincount(owner, minlength=len(texts)) + 1
        self.bounds = np.r_[0, np.cumsum(counts)]
        self.numbers = np.full(self.bounds[-1], self.end, np.int64)
        self.numbers[np.arange(len(number)) + owner] = number
        raw = self.words.cast(pa.binary())
        self.keys = np.fromiter(map(xxhash.xxh3_64_intdigest, raw.to_numpy(zero_copy_only=False)), np.uint64, len(raw)).view(np.int64)
        self.tails = tail_classes(raw)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """The sum over each text of its tokens' values, given by number; the last value is that of the end."""
        return np.add.reduceat(values[self.numbers], self.bounds[:-1]) if len(self.bounds) > 1 else np.empty(0, values.dtype)


def tail_classes(words: pa.Array) -> np.ndarray:
    """The tail class of each word, by its first byte and its last two."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    starts, ends = offsets[:-1], offsets[1:]
    out, full = np.zeros(len(words), np.int64), ends > starts
    starts, ends = starts[full], ends[full]
    mixed = (data[starts].astype(np.uint64) << np.uint64(16)) | (data[np.maximum(ends - 2, starts)].astype(np.uint64) << np.uint64(8)) | data[ends - 1]
    out[full] = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % gru.TAILS
    return out


def counted(train: DataFrame) -> DataFrame:
    """(key, tail, n) of every word of the training texts."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(tables).group_by("key").aggregate([("tail", "min"), ("n", "sum")])
        return found.select(["key", "tail_min", "n_sum"]).rename_columns(["key", "tail", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for start, length in slices(batch.column(0), TOGETHER):
                found = Tokens(batch.column(0).slice(start, length))
                counts = np.bincount(found.numbers, minlength=found.end + 1)[:-1]
                held.append(pa.table({"key": found.keys[counts > 0], "tail": found.tails[counts > 0].astype(np.int32), "n": counts[counts > 0]}))
                size += held[-1].num_rows
                if size >= COUNTED:
                    held = [summed(held)]
                    size = held[0].num_rows
                    if size >= COUNTED / 2:
                        yield from held[0].to_batches(max_chunksize=100_000)
                        held, size = [], 0
        if held:
            yield from summed(held).to_batches(max_chunksize=100_000)

    texts = train.select(F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(tidied(run), "key bigint, tail int, n bigint").groupBy("key").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


class Vocabulary:
    """What a worker needs: counts and model ids of the hot words, and the mass of each tail class.

    The hot words stay in a table of the shared folder until a worker asks for them.
    """

    def __init__(self, path: str, ends: int, tail_mass: np.ndarray, learned: np.ndarray, total: int, distinct: int):
        self.path, self.ends, self.tail_mass, self.learned, self.total, self.distinct = path, ends, tail_mass, len(learned), total, distinct
        self.learned_counts = np.zeros(gru.LEARNED)
        self.learned_counts[: len(learned) + 1] = [ends, *learned]

    def load(self) -> None:
        """Read the hot words, most frequent first; the first of them are the learned outputs."""
        rows = read_published(self.path)
        keys, counts = rows.column("key").to_numpy(), rows.column("n").to_numpy()
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((keys, -counts))] = np.arange(1, len(keys) + 1)
        order = np.argsort(keys)
        self.keys, self.counts, self.ranks = keys[order], counts[order].astype(np.float64), rank[order]

    def rows(self, found: Tokens) -> np.ndarray:
        """The row of each word among the hot ones; -1 for words that are not hot."""
        out = np.full(len(found.keys), -1)
        if len(self.keys):
            order = np.argsort(found.keys)  # a search for ascending keys goes on where the last one ended
            asked = found.keys[order]
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            out[order] = np.where(self.keys[at] == asked, at, -1)
        return out

    def counts_of(self, rows: np.ndarray) -> np.ndarray:
        """The count of each word, by its row, and of the end; -1 for words that are not hot."""
        return np.r_[np.where(rows >= 0, self.counts[rows], -1.0) if len(self.keys) else np.full(len(rows), -1.0), self.ends]

    def model_ids(self, found: Tokens, rows: np.ndarray) -> np.ndarray:
        """The model's id of each word and of the end, 0: learned words' own ids, the ids of tail classes for all others."""
        rank = np.where(rows >= 0, self.ranks[rows], self.learned + 1) if len(self.keys) else np.full(len(rows), self.learned + 1)
        return np.r_[np.where(rank <= self.learned, rank, gru.LEARNED + found.tails), 0]


#: The vocabulary that a worker has loaded, by its path.
_LOADED: dict[str, Vocabulary] = {}


def loaded(vocabulary: Vocabulary) -> Vocabulary:
    if vocabulary.path not in _LOADED:
        _LOADED.clear()
        vocabulary.load()
        _LOADED[vocabulary.path] = vocabulary
    return _LOADED[vocabulary.path]


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """From the counts of all words. The tail classes' masses leave out the learned words."""
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    hot = most_frequent(counts, "n", HOT)
    tails = np.zeros(gru.TAILS)
    for row in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        tails[row["tail"]] = row["n"] + SMOOTHING * row["kinds"]
    first = hot.orderBy(F.desc("n"), "key").limit(gru.LEARNED - 1).collect()
    for row in first:
        tails[row["tail"]] -= row["n"] + SMOOTHING
    return Vocabulary(published(hot, "hotwords"), ends, np.maximum(tails, 0) + SMOOTHING, np.array([row["n"] for row in first]), (totals[0] or 0) + ends, totals[1] + (1 if ends else 0))


def summed(vectors: DataFrame) -> DataFrame:
    """(params, weight) added up per partition."""

    def run(batches):
        total, weight = 0.0, 0.0
        for batch in batches:
            for vector, w in zip(batch.column(0), batch.column(1), strict=True):
                total, weight = total + vector.values.to_numpy().astype(np.float64), weight + w.as_py()
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64())), pa.array([weight])], names=["params", "weight"])

    return vectors.mapInArrow(tidied(run), "params array<double>, weight double")


def fitted(train: DataFrame, documents: int, vocab) -> tuple[dict[str, np.ndarray], int]:
    """The parameters after both rounds and the tokens that were read; vocab is a broadcast Vocabulary."""
    spark = train.sparkSession
    params = gru.initial(vocab.value.learned_counts, vocab.value.tail_mass)
    seen = 0
    if not documents:
        return params, seen
    like = {name: np.zeros_like(value) for name, value in params.items()}
    texts = train.select(F.coalesce("text", F.lit("")).alias("text"))
    early = F.pmod(F.xxhash64("text"), F.lit(FIRST_SHARE)) == 0
    for part in (early, ~early):
        given = spark.sparkContext.broadcast(gru.pack(params))

        def run(batches, given=given):
            v, trainer, weight = loaded(vocab.value), gru.Trainer(gru.unpack(given.value, like)), 0
            for batch in batches:
                for start, length in slices(batch.column(0), TOGETHER):
                    found = Tokens(batch.column(0).slice(start, length))
                    trainer.read(np.split(v.model_ids(found, v.rows(found))[found.numbers], found.bounds[1:-1]))
                    weight += len(found.numbers)
            if weight:
                total = (gru.pack(trainer.params) * np.float32(weight)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float32())), pa.array([float(weight)])], names=["params", "weight"])

        rows = summed(texts.filter(part).mapInArrow(tidied(run, HELD), "params array<float>, weight double").repartition(math.isqrt(documents // MERGED_DOCS) + 1))
        averaged = rows.select("weight", F.posexplode("params").alias("at", "value")).groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value"), F.sum("weight").alias("weight")).toPandas()
        if len(averaged):
            flat = np.empty(len(averaged), np.float32)
            flat[averaged["at"].to_numpy()] = averaged["value"].to_numpy()
            params, seen = gru.unpack(flat, like), seen + int(averaged["weight"].iloc[0])
    return params, seen


def scored(docs: DataFrame, vocab, params: dict) -> DataFrame:
    """Per row (_rid, id, held_out): numbers of tokens and of hot known ones, sums of logs, and the keys of rare words."""
    model = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches):
        v, weights = loaded(vocab.value), model.value
        mass = np.log10(v.tail_mass)
        for batch in batches:
            for start, length in slices(batch.column(1), TOGETHER):
                piece = batch.slice(start, length)
                found = Tokens(piece.column(1))
                rows = v.rows(found)
                counts, ids = v.counts_of(rows), v.model_ids(found, rows)
                hot = counts >= 0
                logs = np.where(hot, np.log10(np.maximum(counts, 0) + SMOOTHING), 0.0)
                tail = np.where(ids >= gru.LEARNED, logs - mass[np.maximum(ids - gru.LEARNED, 0)], 0.0)
                model_log = gru.log_likelihoods(weights, np.split(ids[found.numbers], found.bounds[1:-1])) / LN10
                rare = ~hot[found.numbers]
                offsets = np.r_[0, np.cumsum(rare)][found.bounds].astype(np.int32)
                rare_keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.r_[found.keys, 0][found.numbers[rare]]))
                known = found.per_text((counts > 0).astype(np.int64))
                arrays = [piece.column(0), piece.column(2), piece.column(3), pa.array(np.diff(found.bounds)), pa.array(known), pa.array(found.per_text(logs)), pa.array(model_log + found.per_text(tail)), rare_keys]
                yield pa.RecordBatch.from_arrays(arrays, names=["_rid", "id", "held_out", "n_tokens", "known", "base", "model", "rare"])

    return docs.select("_rid", "text", "id", "held_out").mapInArrow(tidied(run, HELD), "_rid bigint, id bigint, held_out boolean, n_tokens bigint, known bigint, base double, model double, rare array<bigint>")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of the query's contract for every document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), (crc_mod(id_col, HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = rows.filter(~F.col("held_out"))
    counts = stored(counted(train), "counts")
    ends = train.count()
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(counts, ends))
    params, _ = fitted(train, ends, vocab)
    found = stored(scored(with_row_id(rows), vocab, params), "scores")
    rare = found.select("_rid", F.explode("rare").alias("key")).groupBy("_rid", "key").agg(F.count("*").alias("times"))
    joined = rare.join(counts.select("key", "n"), "key", "left")
    sums = joined.groupBy("_rid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known")
    )
    v = vocab.value
    per_token = math.log10(v.total + SMOOTHING * (v.distinct + 1))
    out = found.drop("rare").join(sums, "_rid", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(v.total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("model") + rare_log).alias("score"),
    )
