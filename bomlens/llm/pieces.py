"""SentencePiece encoding and decoding as a relational lattice.

1. A text is escaped (a leading space, spaces as the mark) and cut into words that no piece of the table crosses. The
   distinct words of all texts form the word table, with the input partitions in which each stands.
2. Every substring of a word up to the longest piece is exploded and equi-joined to the piece table: the edges of the
   word's lattice. The piece table is broadcast; its size is that of the model file.
3. The edges are grouped by word, where they were made, and folded with Spark's higher-order `aggregate`.
   Words are dealt anew before, WORDS_A_TASK at a time: their edges weigh far more than their bytes, by which files are
   packed into tasks, and a slow executor holds no more than a few seconds of the stage.
4. Encoded words return to the texts. A worker reads up to HOT of the most frequent words, a bounded table, and the other
   words of its own input partition, which step 1 has listed; so no text and no list of ids is shuffled.

The fold follows the model's type. A model of log-probabilities takes Viterbi: the fold goes over the edges by their end,
carries the best score and the back pointer of every position, and the best path is read off backwards. Of equal scores the
longest last piece stays. A byte-pair model gives pieces their merge ranks; a best path through the lattice gives other
pieces than the model's own library does, so its fold merges along the lattice: it goes over the edges by rank and start,
carries the end of the symbol that starts at each position, and joins the two symbols that an edge spans. One pass is
enough when every piece of the model is made from pieces of lower rank, which is checked for each piece of the table.

Characters without a piece become the pieces of their UTF-8 bytes, or one unknown piece a run where the model has none.
Decoding joins the pieces' bytes and drops the leading space.

Defined cases: null and empty texts have no pieces and decode to ''; a literal mark in a text decodes to a space, as in the
model's own library; repeated rows are encoded once each; extra columns, whatever their names, are ignored; a word of any
length takes the same path, at a cost that grows with the square of its length beyond some thousand characters.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from bomlens.llm.common import is_frequent, published, read_published, released, scans_files, shared_folder, slices, stored, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Letters or other characters in a row, with the marks before them; a line break stands alone.
NUMERALS = r"\d_²³¹¼-¾"
SEGMENT = re.compile(rf"{MARK}*[^\W{NUMERALS}]+|{MARK}*(?:[^\w{MARK}\n]|[{NUMERALS}])+|{MARK}+|\n")
#: Words that every worker reads: so many of the most frequent up to HOT_CHARS characters, and of longer ones so many up to LONG_CHARS.
HOT, HOT_CHARS = 1 << 19, 48
HOT_LONG, LONG_CHARS = 4096, 2048
#: Words counted by a worker at once, and bytes of texts taken together.
COUNTED, TOGETHER = 800_000, 2_000_000
#: Words whose lattice one task makes and folds.
WORDS_A_TASK = 1 << 15
BEST, MERGES = "best path", "merges"
#: Bits of a packed edge below its rank: start, length, id.
START_BITS, LENGTH_BITS, ID_BITS = 24, 6, 17
NO_ID = (1 << ID_BITS) - 1
#: Characters by which a start looks up how far its pieces reach.
PREFIX = 4


def _model_type(proto: bytes) -> int:
    """The model type in a serialized model: field 3 of the message in field 2; 1 (log-probabilities) where unset."""

    def fields(data: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            else:
                size = varint() if kind == 2 else 8 if kind == 1 else 4
                yield tag >> 3, data[at : at + size]
                at += size

    trainer = next((value for number, value in fields(proto) if number == 2), b"")
    return next((value for number, value in fields(trainer) if number == 3), 1)


class PieceTable:
    """The pieces of a model: rows (name, id, place, score), the first id of the 256 bytes or None, the unknown id, the fold.

    place is the rank of a piece among the scores, from 0 for the highest; in a byte-pair model it is the merge rank.
    """

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(n) for n in range(model.get_piece_size())]
        special = {n for n in range(len(names)) if model.is_control(n) or model.is_unknown(n)}
        found = [n for n in range(len(names)) if model.is_byte(n)]
        kind = MERGES if _model_type(model.serialized_model_proto()) == 2 else BEST
        self._fill(names, [model.get_score(n) for n in range(len(names))], special, found[0] if found else None, model.unk_id(), kind)

    @classmethod
    def of(cls, names: list[str], scores: list[float], kind: str = BEST, byte_base: int | None = None, unknown: int = 0) -> PieceTable:
        """A table from names and scores by id; the unknown id is no piece."""
        out = cls.__new__(cls)
        out._fill(names, scores, {unknown}, byte_base, unknown, kind)
        return out

    def _fill(self, names, scores, special, byte_base, unknown, kind) -> None:
        self.names, self.byte_base, self.unknown, self.kind = names, byte_base, unknown, kind
        raw = range(byte_base, byte_base + 256) if byte_base is not None else range(0)
        if any(names[byte_base + b] != f"<0x{b:02X}>" for b in range(len(raw))):
            raise ValueError("the byte pieces are not in order")
        plain = [n for n in range(len(names)) if n not in special and n not in raw]
        if any(SEGMENT.findall(names[n]) != [names[n]] for n in plain):
            raise ValueError("a piece crosses the cuts between words")
        places = {score: float(k) for k, score in enumerate(sorted({scores[n] for n in plain}, reverse=True))}
        by_name = {names[n]: places[scores[n]] for n in plain}
        if kind == MERGES:
            _order_merges(by_name)
        order = {place: k for k, place in enumerate(sorted(set(by_name.values())))}
        self.rows = [(names[n], n, order[by_name[names[n]]], float(scores[n])) for n in plain]
        self.longest = max((len(name) for name in by_name), default=1)
        self.unknown_score = min((scores[n] for n in plain), default=0.0) - 10.0
        if self.longest >= 1 << LENGTH_BITS or len(names) > NO_ID or len(order) >= 1 << 16:
            raise ValueError("the piece table is too large for packed edges")
        self.bytes = [bytes([n - byte_base]) if n in raw else b"" if n in special else names[n].replace(MARK, " ").encode() for n in range(len(names))]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "piece string, id int, place int, score double")


def merged_in_order(word: str, places: dict[str, float], longest: int) -> list[int]:
    """The end of the symbol that starts at each position, -1 where none does, after merging by (place, start) in one pass."""
    after = list(range(1, len(word) + 1))
    edges = sorted((places[word[s:e]], s, e) for s in range(len(word)) for e in range(s + 2, min(len(word), s + longest) + 1) if word[s:e] in places)
    for _, start, end in edges:
        middle = after[start]
        if 0 < middle < len(word) and after[middle] == end:
            after[start], after[middle] = end, -1
    return after


def _order_merges(places: dict[str, float]) -> None:
    """Raise the places of pieces that rank above all their halves to just behind a half; fail if a piece still is not made in one pass."""
    longest = max(map(len, places), default=1)
    for name in sorted(places, key=lambda x: (len(x), x)):
        if len(name) > 1 and merged_in_order(name, places, longest)[0] != len(name):
            halves = [max(places[name[:k]], places[name[k:]]) for k in range(1, len(name)) if name[:k] in places and name[k:] in places]
            if halves:
                places[name] = min(halves) + 0.5
            if merged_in_order(name, places, longest)[0] != len(name):
                raise ValueError(f"{name!r} is not made by merges in order of rank")


def segments(text: str | None) -> list[str]:
    """The words of a text, marks included."""
    return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []


def tokens(texts: pa.Array) -> pa.ListArray:
    """Per text, tokens that no word crosses: cut at line breaks and before spaces, with marks for the spaces; some are empty."""
    special = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.or_(pc.starts_with(texts, " "), pc.equal(pc.binary_length(texts), 0)))
    special = special.to_numpy(zero_copy_only=False)
    quick = texts.filter(pa.array(~special)) if special.any() else texts
    spaced = pc.replace_substring(pc.replace_substring(quick, " ", " " + MARK), "\n", " \n ")
    lists = pc.split_pattern(pc.binary_join_element_wise(MARK, spaced, ""), " ")
    if not special.any():
        return lists
    whole = pa.array([segments(text) for text in texts.filter(pa.array(special)).to_pylist()], pa.list_(pa.string()))
    return pa.concat_arrays([lists, whole]).take(pa.array(np.argsort(np.r_[np.flatnonzero(~special), np.flatnonzero(special)])))


def words_of(found: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of tokens in the tokens' order, and the number of the token of each."""
    simple = pc.utf8_is_alpha(pc.utf8_ltrim(found, MARK)).to_numpy(zero_copy_only=False)
    mixed = np.flatnonzero(~simple)
    parts = [SEGMENT.findall(token) for token in found.take(pa.array(mixed)).to_pylist()]
    words = pa.concat_arrays([found.filter(pa.array(simple)), pa.array(list(chain.from_iterable(parts)), pa.string())])
    owner = np.r_[np.flatnonzero(simple), np.repeat(mixed, np.fromiter(map(len, parts), np.int64, len(parts)))]
    order = np.argsort(owner, kind="stable")
    return words.take(pa.array(order)), owner[order]


def word_table(texts: DataFrame) -> DataFrame:
    """(word, n, parts): the distinct words of column text, their number, and the input partitions that hold them."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    def run(batches):
        part = TaskContext.get().partitionId()
        held, size = [], 0

        def listed(table: pa.Table):
            return table.append_column("part", pa.array(np.full(table.num_rows, part, np.int32))).to_batches(max_chunksize=100_000)

        for batch in batches:
            for start, length in slices(batch.column(0), TOGETHER):
                coded = tokens(batch.column(0).slice(start, length)).flatten().dictionary_encode()
                counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                words, owner = words_of(coded.dictionary)
                held.append(pa.table({"word": words, "n": counts[owner]}))
                size += len(words)
                if size >= COUNTED:
                    held = [summed(held)]
                    size = held[0].num_rows
                    if size >= COUNTED / 2:
                        yield from listed(held[0])
                        held, size = [], 0
        if held:
            yield from listed(summed(held))

    def gathered(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            found = pa.Table.from_batches(parts).group_by("word").aggregate([("n", "sum"), ("part", "distinct")])
            yield from found.select(["word", "n_sum", "part_distinct"]).rename_columns(["word", "n", "parts"]).to_batches(max_chunksize=100_000)

    rows = texts.select("text").mapInArrow(tidied(run), "word string, n bigint, part int")
    return rows.repartition("word").mapInArrow(tidied(gathered), "word string, n bigint, parts array<int>")


def dealt(words: DataFrame) -> DataFrame:
    """words, stored before, dealt evenly to tasks of about WORDS_A_TASK rows."""
    return words.repartition(max(1, -(-words.count() // WORDS_A_TASK)))


def longest_by_prefix(table: PieceTable) -> list[tuple[str, int]]:
    """(prefix, longest): for the first PREFIX characters of the pieces that are as long, the length of the longest such piece."""
    found: dict[str, int] = {}
    for name, *_ in table.rows:
        if len(name) >= PREFIX:
            found[name[:PREFIX]] = max(found.get(name[:PREFIX], 0), len(name))
    return sorted(found.items())


def lattice(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, note, edges) of words (word, note): all pieces inside each word, and one edge for a character without a piece.

    A best-path edge is a struct (end, start, score, id). A merging model packs an edge as place, start, length and id,
    with place 0 for single characters; sorted, they come first and in order.

    A start looks up the longest piece that begins with its PREFIX characters, and only substrings up to there are exploded
    and joined to the pieces. Both tables are broadcast, so the edges of a word follow one another, from that of its first
    character on, and are grouped as they come, a batch at a time.
    """
    spark, best, size = words.sparkSession, table.kind == BEST, F.char_length("word")
    prefixes = spark.createDataFrame(longest_by_prefix(table), "prefix string, longest int")
    starts = words.select("word", "note", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    starts = starts.withColumn("prefix", F.substring(F.col("word"), F.col("s") + 1, F.lit(PREFIX))).join(F.broadcast(prefixes), "prefix", "left")
    furthest = F.least(F.col("s") + F.coalesce("longest", F.lit(PREFIX - 1)), size)
    ends = starts.select("word", "note", "s", F.explode(F.sequence(F.col("s") + 1, furthest)).alias("e"))
    first = (F.col("s") == 0) & (F.col("e") == 1)
    cut = ends.select("s", "e", F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s")).alias("piece"), F.when(first, F.concat_ws(" ", F.coalesce("note", F.lit("")), F.col("word"))).alias("head"))
    one = F.col("e") == F.col("s") + 1
    found = cut.join(F.broadcast(table.frame(spark)), "piece", "left").filter(F.col("id").isNotNull() | one)
    if best:
        edge = F.struct("e", "s", F.coalesce("score", F.lit(table.unknown_score)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    else:
        place = F.shiftleft(F.when(one, 0).otherwise(F.col("place") + 1).cast("bigint"), START_BITS + LENGTH_BITS + ID_BITS)
        edge = place.bitwiseOR(F.shiftleft(F.col("s").cast("bigint"), LENGTH_BITS + ID_BITS)).bitwiseOR(F.shiftleft((F.col("e") - F.col("s")).cast("bigint"), ID_BITS)).bitwiseOR(F.coalesce("id", F.lit(NO_ID)).cast("bigint"))
    rows = found.select(edge.alias("edge"), "head")

    def group(edge_: pa.Array, head: pa.Array, starts_: np.ndarray) -> pa.RecordBatch:
        offsets = np.r_[starts_, len(head)].astype(np.int32)
        if not best:
            values = edge_.to_numpy()
            edge_ = pa.array(values[np.lexsort((values, np.repeat(np.arange(len(starts_)), np.diff(offsets))))])
        return pa.RecordBatch.from_arrays([head.take(pa.array(starts_)), pa.ListArray.from_arrays(pa.array(offsets), edge_)], names=["head", "edges"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            edge_, head = (pa.concat_arrays([held[k], batch.column(k)]) if held else batch.column(k) for k in range(2))
            starts_ = np.flatnonzero(head.is_valid().to_numpy(zero_copy_only=False))
            last = int(starts_[-1])  # the last word may go on in the next batch
            if last:
                yield group(edge_.slice(0, last), head.slice(0, last), starts_[:-1])
            held = edge_.slice(last), head.slice(last)
        if held:
            yield group(*held, np.zeros(1, np.int64))

    grouped = rows.mapInArrow(tidied(run), StructType().add("head", StringType()).add("edges", ArrayType(rows.schema["edge"].dataType)))
    return grouped.select(F.expr("substr(head, instr(head, ' ') + 1)").alias("word"), F.substring_index("head", " ", 1).alias("note"), "edges")


def _bind(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _raw(word: Column, at: Column, table: PieceTable) -> Column:
    """The ids of a character without a piece."""
    if table.byte_base is None:
        return F.array(F.lit(table.unknown))
    hexed = F.hex(F.encode(F.substring(word, at + 1, F.lit(1)), "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")), lambda b: F.conv(F.substring(hexed, (b * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + table.byte_base)


def merged(edges: Column, word: Column, table: PieceTable) -> Column:
    """The ids of a word by merging along its packed and sorted edges, single characters first."""
    size, mask = F.char_length(word), F.lit(NO_ID).cast("bigint")
    dead = F.array(F.lit(-1).cast("bigint"))

    def start(edge):
        return F.shiftright(edge, LENGTH_BITS + ID_BITS).bitwiseAND(F.lit((1 << START_BITS) - 1).cast("bigint")).cast("int")

    def end(symbol):
        return F.shiftright(symbol, ID_BITS).cast("int")

    # symbols[s] is the symbol that starts at s, as end and id; -1 where none starts
    def step(symbols, edge):
        s = start(edge)
        e = s + F.shiftright(edge, ID_BITS).bitwiseAND(F.lit((1 << LENGTH_BITS) - 1).cast("bigint")).cast("int")
        m = end(F.get(symbols, s))
        symbol = F.shiftleft(e.cast("bigint"), ID_BITS).bitwiseOR(edge.bitwiseAND(mask))
        joined = F.concat(F.slice(symbols, F.lit(1), s), F.array(symbol), F.slice(symbols, s + 2, m - s - 1), dead, F.slice(symbols, m + 2, F.size(symbols)))
        return F.when(end(F.get(symbols, m)) == e, joined).otherwise(symbols)

    singles = F.transform(F.slice(edges, F.lit(1), size), lambda edge, at: F.shiftleft((at + 1).cast("bigint"), ID_BITS).bitwiseOR(edge.bitwiseAND(mask)))
    done = F.aggregate(F.slice(edges, size + 1, F.size(edges)), singles, step)

    def ids(symbols: Column) -> Column:
        live = F.transform(F.filter(symbols, lambda x: x > 0), lambda x: x.bitwiseAND(mask).cast("int"))
        placed = F.filter(F.transform(symbols, lambda x, at: F.struct(x.alias("symbol"), at.alias("s"))), lambda x: x["symbol"] > 0)
        mixed = F.transform(placed, lambda x: F.when(x["symbol"].bitwiseAND(mask) == NO_ID, _raw(word, x["s"], table)).otherwise(F.array(x["symbol"].bitwiseAND(mask).cast("int"))))
        if table.byte_base is None:  # a run of unknown characters is one piece
            return F.filter(live, lambda x, at: (x != NO_ID) | F.coalesce(F.get(live, at - 1) != NO_ID, F.lit(True)))
        return _bind(live, lambda found: F.when(F.array_contains(found, F.lit(NO_ID)), F.flatten(mixed)).otherwise(found))

    found = _bind(done, ids)
    return found if table.byte_base is not None else F.transform(found, lambda x: F.when(x == NO_ID, F.lit(table.unknown)).otherwise(x))


def best_path(edges: Column, word: Column, table: PieceTable) -> Column:
    """The ids of a word by Viterbi: the path of edges with the greatest sum of scores."""
    size = F.char_length(word)
    back = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("id"))
    zero = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(back).alias("back"))

    # best[e] and back[e] are the best score of a path to e and its last edge; edges come by their end
    def step(acc, edge):
        total = F.get(acc["best"], edge["s"]) + edge["score"]
        pointer = F.struct(edge["s"].alias("s"), edge["id"].alias("id"))
        added = F.struct(F.concat(F.slice(acc["best"], F.lit(1), edge["e"]), F.array(total)).alias("best"), F.concat(F.slice(acc["back"], F.lit(1), edge["e"]), F.array(pointer)).alias("back"))
        reached = F.get(acc["best"], edge["e"])
        return F.when(reached.isNull() | (total > reached), added).otherwise(acc)

    pointers = F.aggregate(F.sort_array(edges), zero, step, lambda acc: acc["back"])

    def walked(done: Column) -> Column:
        places = F.reverse(F.transform(done, lambda x, at: F.struct(at.alias("e"), x["s"].alias("s"), x["id"].alias("id"))))
        start = F.struct(size.alias("at"), F.array().cast("array<struct<s:int,id:int>>").alias("path"))

        def back_step(acc, x):
            taken = F.struct(x["s"].alias("at"), F.concat(F.array(F.struct(x["s"].alias("s"), x["id"].alias("id"))), acc["path"]).alias("path"))
            return F.when((x["e"] == acc["at"]) & (x["e"] > 0), taken).otherwise(acc)

        return F.aggregate(places, start, back_step, lambda acc: acc["path"])

    def ids(path: Column) -> Column:
        if table.byte_base is None:  # a run of unknown characters is one piece
            path = F.filter(path, lambda x, at: (x["id"] >= 0) | F.coalesce(F.get(path, at - 1)["id"] >= 0, F.lit(True)))
        return F.flatten(F.transform(path, lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(_raw(word, x["s"], table))))

    return _bind(_bind(pointers, walked), ids)


def encoded_words(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, note, ids) of words (word, note); a note goes with each word and has no space."""
    fold = best_path if table.kind == BEST else merged
    return lattice(words, table).withColumn("ids", fold(F.col("edges"), F.col("word"), table)).drop("edges")


def _keys(words: pa.Array) -> np.ndarray:
    """The signed 64-bit keys of words, those of Spark's xxhash64."""
    return np.fromiter((xxhash.xxh64_intdigest(word, 42) for word in words.cast(pa.binary()).to_pylist()), np.uint64, len(words)).view(np.int64)


def spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The parts of flat that start at starts and have the given sizes, for all rows, one after another."""
    sizes = sizes[rows]
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - ends + sizes, sizes)]


class Encoded:
    """Words by key with their ids, each in one flat array."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        keys = rows.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        lists = [chunk for chunk in rows.column("ids").chunks if len(chunk)]
        self.flat = np.concatenate([np.asarray(x.flatten()) for x in lists]).astype(np.int32) if lists else np.empty(0, np.int32)
        sizes = np.concatenate([np.asarray(x.value_lengths()) for x in lists]).astype(np.int64) if lists else np.empty(0, np.int64)
        self.starts, self.sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


#: The hot words that a worker has read, by their path.
_LOADED: dict[str, Encoded] = {}


def _hot_words(path: str) -> Encoded:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Encoded(read_published(path))
    return _LOADED[path]


class Speller:
    """The ids of texts in a worker: hot words, the words of the input partition, and for any other the whole word table.

    The last is only needed when the input is cut into other partitions than when the words were listed.
    """

    def __init__(self, hot: str, own: str, every: str):
        self.tables = [_hot_words(hot)]
        if (rows := read_published(own, missing_ok=True)) is not None:
            self.tables.append(Encoded(rows.select(["key", "ids"])))
        self.every = every
        released()  # what reading them took, before texts are encoded

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, sizes): the ids of the words with these keys."""
        flats, starts, sizes, left, at = [], np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        for number in range(len(self.tables) + 1):
            if number == len(self.tables) and not len(left):
                break
            table = self.tables[number] if number < len(self.tables) else Encoded(read_published(self.every, keys=pa.array(keys[left])))
            rows = table.find(keys[left])
            there = rows >= 0
            flats.append(spread(table.flat, table.starts, table.sizes, rows[there]))
            own = table.sizes[rows[there]]
            sizes[left[there]], starts[left[there]] = own, at + np.cumsum(own) - own
            left, at = left[~there], at + len(flats[-1])
        if len(left):
            raise ValueError("a word was not listed; the input has changed between its two readings")
        return np.concatenate(flats), starts, sizes

    def encode(self, texts: pa.Array) -> pa.ListArray:
        lists = tokens(texts)
        coded = lists.flatten().dictionary_encode()
        words, owner = words_of(coded.dictionary)
        named = words.dictionary_encode()
        flat, starts, sizes = self.look_up(_keys(named.dictionary))
        word = named.indices.to_numpy()
        flat = spread(flat, starts, sizes, word)
        token_sizes = np.bincount(owner, weights=sizes[word], minlength=len(coded.dictionary)).astype(np.int64)
        token = coded.indices.to_numpy()
        ends = np.r_[0, np.cumsum(token_sizes[token])]
        bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        return pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(spread(flat, np.cumsum(token_sizes) - token_sizes, token_sizes, token)))


def encode(docs: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, ids): the piece ids of every text."""

    def emit(ids: pa.Array, texts: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        digests = [hashlib.sha256(text).hexdigest() for text in texts.cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.string()), lists], names=["id", "text_sha256", "ids"])

    return encoded(docs, table, emit, "id bigint, text_sha256 string, ids array<int>", id_col, text_col)


def encoded(docs: DataFrame, table: PieceTable, emit, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What emit(ids, texts, lists of piece ids) gives for all texts, a few megabytes of them at a time.

    The texts are read twice: once to list the words, once to encode. Anything but a scan of files is stored first.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not scans_files(texts):
        texts = stored(texts, "texts")
    words = stored(word_table(texts), "wordtable").select("word", F.concat_ws(",", F.col("n").cast("string"), F.col("parts").cast("array<string>")).alias("note"))
    every = shared_folder(spark, "words")
    note = F.split("note", ",", 2)
    encoded_words(dealt(words), table).select(F.xxhash64("word").alias("key"), F.char_length("word").alias("chars"), note[0].cast("bigint").alias("n"), note[1].alias("parts"), "ids").write.option("compression", "zstd").parquet(every)
    known = spark.read.parquet(every)
    short = known.filter(F.col("chars") <= HOT_CHARS)
    long = known.filter(F.col("chars").between(HOT_CHARS + 1, LONG_CHARS))
    hot = (F.col("chars") <= HOT_CHARS) & is_frequent(short, "n", HOT) | F.col("chars").between(HOT_CHARS + 1, LONG_CHARS) & is_frequent(long, "n", HOT_LONG)
    hot_path, own = published(known.filter(hot).select("key", "ids"), "hotwords"), shared_folder(spark, "partwords")
    known.filter(~hot).select(F.explode(F.split("parts", ",")).alias("part"), "key", "ids").repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(own)

    def run(batches):
        speller = None
        for batch in batches:
            speller = speller or Speller(hot_path, f"{own}/part={TaskContext.get().partitionId()}", every)
            for start, length in slices(batch.column(1), TOGETHER):
                piece = batch.slice(start, length)
                yield emit(piece.column(0), piece.column(1), speller.encode(piece.column(1)))

    return texts.mapInArrow(tidied(run), schema)


def decode_ids(ids, table_bytes: list[bytes]) -> str:
    raw = b"".join([table_bytes[n] for n in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def decode(rows: DataFrame, table: PieceTable, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """rows with the decoded text of a column of piece ids."""
    shared, at = rows.sparkSession.sparkContext.broadcast(table.bytes), rows.columns.index(ids_col)

    def run(batches):
        for batch in batches:
            texts = [decode_ids(x or (), shared.value) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(tidied(run), StructType([*rows.schema.fields]).add(name, StringType()))


def piece_digest(docs: DataFrame, model_path: str = MODEL, **columns: str) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, round_trip): sha256 over the ids as 4-byte little-endian; whether decoding gives the text."""
    table = PieceTable(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(table.bytes)

    def emit(ids: pa.Array, texts: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        flat, bounds = lists.values.to_numpy().astype("<i4"), lists.offsets.to_numpy()
        digests, same = [], []
        for start, end, text in zip(bounds[:-1], bounds[1:], texts.to_pylist(), strict=True):
            digests.append(hashlib.sha256(flat[start:end].tobytes()).hexdigest())
            same.append(decode_ids(flat[start:end].tolist(), shared.value) == text)
        arrays = [ids, pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    return encoded(docs, table, emit, "doc_id bigint, n_pieces bigint, ids_sha256 string, round_trip boolean", **columns)
