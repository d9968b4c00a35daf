"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks.

A sentence is read in stretches: its words, and each two neighbours of together at most JOINED characters with the white
space between them as one inserted character, so that neither "id iot" nor a phrase of two ordinary words is hidden. The
sentence's margin is the greatest of its stretches' margins; a document's score is a calibrated function of its worst
sentence. A sentence ends at a word that ends in a mark of SENTENCE_END; line breaks are white space. The kernel of two
stretches sums their common subsequences of two and of three characters, each weighted by DECAY to the power of the span
it takes, so characters inserted between the letters of an insult cost weight but do not hide it. Both lengths are
normalised on their own. Runs of four or more single characters ("i d i o t") also count as one word; a word over WINDOW
characters is read in overlapping windows, all of it. An insult parted by spaces into three pieces, not all of one
character, or into two of together over JOINED characters, is read piece by piece.

Training (labelled sentences): sentences inherit their document's label. Words that stand in many toxic and hardly any
clean documents are the first witnesses; the machine is then refitted with the clean stretches nearest to the margin, and
each toxic document not yet explained offers its best stretch. Witnesses are also learnt with characters inserted. The
subsequence weights that the landmarks span are explicit, so scoring a stretch is a sum of table look-ups.

Defined cases: null and empty texts have no sentence and score the calibrated value of LOWEST; equal texts, and so repeated
rows, score alike; a null id is no held-out row; texts of any length are read whole; words that tie for a rank are taken in
alphabetic order; extra columns, whatever their names, are ignored; without labelled rows of both kinds every score is 0; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.llm.common import crc_mod, tidied
from bomlens.llm.sampling import labelled_sample

HELD_OUT = (4, 2)
THRESHOLD = 0.3
#: Bounds of the labelled sample.
PER_CLASS, MAX_CHARS = 2500, 50_000
#: Sampled texts of the more frequent label whose pairs are fitted, and the same share of the other's; all give words.
PAIRED = 1000
LANDMARKS = 240
DECAY = 0.7
WINDOW, STRIDE = 20, 4
#: Characters of two neighbouring words that are also read as one stretch.
JOINED = WINDOW - 1
SENTENCE_END = ".!?"
RIDGE = 1e-8
LOWEST = -3.0
ALPHABET = 32
REMEMBERED = 250_000
#: Bytes up to which a worker keeps freed blocks while it scores.
HELD = 1 << 23
EDGE = ".,!?;:\"'()[]{}«»„“”"
INSERTED = ".-*_"
_SPACED = re.compile(r"(?<!\S)(?:\S\s{1,3}){3,}\S[.,!?;:]*(?!\S)")


def _codes() -> dict[int, int]:
    return {ord(c): i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {ord(c): 27 for c in "0123456789"}


_CODES = _codes()


def code(char: str) -> int:
    """1-26 for letters without accents, 27 digits, 30 anything else; letters of other scripts by a hash, 1-29."""
    found = _CODES.get(ord(char))
    if found is None:
        base = unicodedata.normalize("NFD", char)[0]
        found = _CODES.get(ord(base), 1 + (ord(char) * 2654435761 >> 7) % 29 if char.isalpha() else 30)
        _CODES[ord(char)] = found
    return found


def sentence_stretches(text: str | None) -> tuple[set[str], set[str]]:
    """The different words of all sentences and the different short pairs of neighbours, in lower case, without punctuation around words."""
    if not text:
        return set(), set()
    low = text.lower().replace("\0", "\1")
    tokens = low.split()
    bare = {t: t.strip(EDGE) for t in set(tokens)}
    found = set(bare.values())
    found.update("".join(m.split()).strip(EDGE) for m in _SPACED.findall(low))
    found.discard("")
    first = {t: "" if t[-1] in SENTENCE_END else word for t, word in bare.items()}
    neighbours = zip(map(first.__getitem__, tokens), map(bare.__getitem__, tokens[1:]), strict=False)
    return found, {f"{x} {y}" for x, y in neighbours if x and y and len(x) + len(y) <= JOINED}


def windows(word: str) -> list[str]:
    """The overlapping windows of a word, the word itself if it is short."""
    return [word[at : at + WINDOW] for at in range(0, max(1, len(word) - (WINDOW - STRIDE)), STRIDE)] if len(word) > WINDOW else [word]


_TABLE = np.full(0x110000, -1, dtype=np.int64)
_TABLE[0] = 0


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of WINDOW characters padded with 0, number of the word) of every window of every word; no word holds a NUL."""
    pieces, owners = words, range(len(words))
    if max(map(len, words), default=0) > WINDOW:
        cut = [windows(word) for word in words]
        pieces, owners = [p for found in cut for p in found], [n for n, found in enumerate(cut) for _ in found]
    chars = np.frombuffer("".join([p.ljust(WINDOW, "\0") for p in pieces]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _TABLE[chars]
    if codes.size and codes.min() < 0:
        for new in np.unique(chars[codes < 0]).tolist():
            _TABLE[new] = code(chr(new))
        codes = _TABLE[chars]
    return codes.reshape(-1, WINDOW), np.array(owners, dtype=np.int64)


def self_kernels(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kernel of each word with itself for two and for three characters, by the usual recurrence over all words at once."""
    place = np.ascontiguousarray(codes.T.astype(np.int8))
    same = (place[:, None] == place[None]) & (place > 0)[:, None]
    same = same.astype(np.float32)
    two, three = same[1:, 1:] * _spread(same[:-1, :-1].copy()), same[2:, 2:]
    total2 = two.sum(axis=(0, 1))
    inner = _spread(two[:-1, :-1]) if len(place) > 2 else three
    return np.float32(DECAY**4) * total2, np.float32(DECAY**6) * np.einsum("ijn,ijn->n", three, inner)


def _spread(table: np.ndarray) -> np.ndarray:
    """table, in place, with the decayed sums of all earlier rows and columns added."""
    decay, spare = np.float32(DECAY), np.empty(table.shape[1:], np.float32)
    for j in range(1, table.shape[1]):
        table[:, j] += np.multiply(table[:, j - 1], decay, out=spare)
    for i in range(1, len(table)):
        table[i] += np.multiply(table[i - 1], decay, out=spare)
    return table


def weights(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised subsequence weights of a few words: rows of 32^2 and of 32^3."""
    two, three = np.zeros((len(codes), ALPHABET**2), np.float32), np.zeros((len(codes), ALPHABET**3), np.float32)
    for n, row in enumerate(codes):
        used = row[row > 0]
        for i, j in combinations(range(len(used)), 2):
            two[n, used[i] * ALPHABET + used[j]] += DECAY ** (j - i + 1)
        for i, j, k in combinations(range(len(used)), 3):
            three[n, (used[i] * ALPHABET + used[j]) * ALPHABET + used[k]] += DECAY ** (k - i + 1)
    for table in (two, three):
        table /= np.maximum(np.sqrt((table**2).sum(axis=1, keepdims=True)), 1e-9)
    return two, three


def _weighted_sums(codes: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """Normalised subsequence weights of words of one length, summed against tables with a row for each subsequence."""
    n, width = codes.shape
    if n == 1:  # numpy adds up single columns in another order, and a word's margin must not depend on its company
        return _weighted_sums(np.repeat(codes, 2, axis=0), two, three)[:1]
    shape = (n, *two.shape[1:])
    sum2, sum3 = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    if width < 2:
        return sum2
    place = np.ascontiguousarray(codes.T)
    for i in range(width):
        begun = (place[i] * ALPHABET + place[i + 1 :]) * ALPHABET
        for k in range(i + 1, width):
            weight = np.float32(DECAY ** (k - i + 1))
            sum2 += weight * two.take(place[i] * ALPHABET + place[k], axis=0)
            inside = begun[: k - i - 1]
            if len(inside) and len(shape) == 1:
                total = three.take(inside + place[k]).sum(axis=0)
            elif len(inside):  # rows of many columns one at a time, for memory
                total = three.take(inside[0] + place[k], axis=0)
                for start in inside[1:]:
                    total += three.take(start + place[k], axis=0)
            else:
                continue
            total *= weight
            sum3 += total
    norm2, norm3 = (np.maximum(np.sqrt(x), 1e-9).reshape(-1, *[1] * (len(shape) - 1)) for x in self_kernels(codes))
    return sum2 / norm2 + sum3 / norm3


class SubsequenceMachine:
    """Explicit weights of the fitted machine: a table for pairs, one for triples, an offset, and the calibration."""

    def __init__(self, two: np.ndarray, three: np.ndarray, offset: float, slope: float = 1.0, shift: float = 0.0):
        self.two, self.three, self.offset, self.slope, self.shift = two, three, offset, slope, shift

    def margins(self, words: list[str]) -> np.ndarray:
        """The margin of each word; a word without pairs has the offset."""
        if len(words) > 50_000:
            return np.concatenate([self.margins(words[at : at + 50_000]) for at in range(0, len(words), 50_000)])
        if not words:
            return np.empty(0)
        codes, owners = encode(words)
        lengths = (codes > 0).sum(axis=1)
        out = np.full(len(codes), self.offset)
        for width in np.unique(lengths):
            picked = np.flatnonzero(lengths == width)
            for at in range(0, len(picked), 2_000):
                part = picked[at : at + 2_000]
                out[part] += _weighted_sums(codes[part, :width], self.two, self.three)
        best = np.full(len(words), -np.inf)
        np.maximum.at(best, owners, out)
        return best

    def scores(self, margins: np.ndarray) -> np.ndarray:
        """Calibrated scores; beyond its own side of the hinge a margin says nothing more."""
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(margins, -1, 1) + self.shift, -50, 50)))


def fit_margin(features: np.ndarray, labels: np.ndarray, costs: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Squared-hinge machine in the primal, by Newton steps on the violated rows, each halved until the loss falls; the last weight is the offset."""
    x, share = np.c_[features, np.ones(len(features))], costs / costs.sum()
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9

    def loss(weights):
        short = np.maximum(1 - labels * (x @ weights), 0)
        return share @ short**2 + weights @ penalty @ weights, short > 0

    w = np.zeros(x.shape[1])
    value, active = loss(w)
    for _ in range(50):
        a, c = x[active], share[active]
        step = np.linalg.solve(a.T @ (a * c[:, None]) + penalty, a.T @ (c * labels[active])) - w
        for halved in range(12):
            moved, violated = loss(w + step / 2**halved)
            if moved < value:
                break
        else:
            break
        done = (violated == active).all() and not halved
        w, value, active = w + step / 2**halved, moved, violated
        if done:
            break
    return w


def inserted(word: str) -> list[str]:
    """The word with characters inserted between all its letters, with one letter doubled, and parted by a space at each place."""
    if len(word) < 3:
        return []
    middle = len(word) // 2
    parted = [f"{word[:k]} {word[k:]}" for k in range(2, len(word) - 1)] if " " not in word and len(word) <= JOINED else []
    return [c.join(word) for c in INSERTED] + [word[:middle] + word[middle - 1 : middle] + word[middle:]] + parted


def log_odds(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Signed likelihood-ratio statistic of each word of toxic documents."""
    out = {}
    share = n_toxic / (n_toxic + n_clean)
    for word, t in toxic.items():
        c = clean.get(word, 0)
        if t > share * (t + c):
            out[word] = 2 * (t * np.log(t / (share * (t + c))) + (c * np.log(c / ((1 - share) * (t + c))) if c else 0))
    return out


def _numbered(rows: list[tuple[str, int]]) -> tuple[list[tuple[set[str], np.ndarray | None, int]], list[str]]:
    """(words, numbers of the pairs or None beyond PAIRED, label) of each text, and the pairs by number in alphabetic order."""
    sizes, taken = Counter(label for _, label in rows), Counter()
    bags, number = [], {}
    for text, label in rows:
        words, pairs = sentence_stretches(text)
        taken[label] += 1
        paired = taken[label] * max(sizes.values()) <= PAIRED * sizes[label]
        bags.append((words, np.fromiter((number.setdefault(p, len(number)) for p in pairs), np.int64, len(pairs)) if paired else None, label))
    names = sorted(number)
    place = np.empty(len(names), np.int32)
    place[[number[p] for p in names]] = np.arange(len(names))
    return [(words, None if found is None else place[found], label) for words, found, label in bags], names


def fit(rows: list[tuple[str, int]]) -> SubsequenceMachine | None:
    """The machine from labelled texts; None unless both labels occur."""
    if len({label for _, label in rows}) < 2:
        return None
    toxic, clean = Counter(), Counter()
    bags, pair_names = _numbered(rows)
    pair_times = np.zeros((2, len(pair_names)), np.int32)
    for bag, pairs, label in bags:
        (toxic if label else clean).update(bag)
        if pairs is not None:
            pair_times[int(label), pairs] += 1
    clean_pairs = np.flatnonzero(pair_times[0])
    toxic_times, clean_times = {}, {}
    n_toxic = sum(label for _, _, label in bags)
    odds = log_odds(toxic, clean, n_toxic, len(bags) - n_toxic)
    share, whole = n_toxic / len(bags), [bag for bag in bags if bag[1] is not None]
    ranked = sorted((w for w in odds if len(w) > 2), key=lambda w: (-odds[w], w))
    witnesses = [w for w in ranked if odds[w] > 15 and clean.get(w, 0) <= 0.01 * toxic[w]] or ranked[:5]
    witnesses = witnesses[:4000]
    common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if len(w) > 1]
    negatives = common[:3000] + common[3000 :: max(1, len(common) // 12_000)]
    half = LANDMARKS // 2
    spread_out = witnesses[half // 2 :][:: max(1, len(witnesses) * 2 // half)][: half // 2]
    gapped = [v for w in witnesses[:12] for v in inserted(w)[:1] + inserted(w)[5::2]]
    landmarks = list(dict.fromkeys(witnesses[: half // 2] + gapped + spread_out + negatives[:: max(1, len(negatives) // half)][:half]))
    codes, _ = encode([w[:WINDOW] for w in landmarks])  # a landmark may be any string
    two, three = weights(codes)
    values, vectors = np.linalg.eigh(two @ two.T + three @ three.T)
    kept = values > 1e-4 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    by_pair, by_triple = np.ascontiguousarray(two.T @ whiten), np.ascontiguousarray(three.T @ whiten)
    machine, seen = None, {}

    def features(words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in seen]
        seen.update(zip(new, _features(new, by_pair, by_triple), strict=True))
        return np.array([seen[w] for w in words])

    for _ in range(4):
        positive = {v: float(toxic[w] or toxic_times[w]) for w in witnesses for v in windows(w)}
        positive |= {x: (toxic[w] or toxic_times[w]) / 4 for w in witnesses[:300] for v in inserted(w) for x in windows(v)}
        negative = {v: 1.0 + np.log1p(clean.get(w, 0) or clean_times.get(w, 0)) for w in negatives for v in windows(w)} | {x: 0.5 for w in common[:300] for v in inserted(w) for x in windows(v)}
        labels = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        costs = [np.array(list(part.values())) for part in (positive, negative)]
        costs = np.concatenate([c / c.sum() * share for c, share in zip(costs, (1, 2), strict=True)])
        w = fit_margin(features([*positive, *negative]), labels, costs, RIDGE)
        machine = SubsequenceMachine((by_pair @ w[:-1]).astype(np.float32), (by_triple @ w[:-1]).astype(np.float32), float(w[-1]))
        clean_margins = machine.margins(common)
        near = [common[i] for i in np.argsort(-clean_margins)[:3000] if clean_margins[i] > -0.7]
        pair_margins = machine.margins(pair_names)
        for i in clean_pairs[np.argsort(-pair_margins[clean_pairs], kind="stable")[:3000]]:
            if pair_margins[i] > -0.7:
                near.append(pair_names[i])
                clean_times[pair_names[i]] = int(pair_times[0, i])
        known = dict(zip(toxic, machine.margins(list(toxic)).tolist(), strict=True))
        offered = set()
        for bag, pairs, label in bags:
            pairs = np.empty(0, np.int32) if pairs is None else pairs
            if label and bag and max(max(known[x] for x in bag), pair_margins[pairs].max(initial=LOWEST)) < 0.5:
                free = [(odds[x], known[x], x) for x in bag if x not in clean and odds.get(x, 0) > 4]
                only = pairs[pair_times[0, pairs] == 0]
                free += [(2 * pair_times[1, i] * -np.log(share), pair_margins[i], pair_names[i]) for i in only]
                free = [x for x in free if " " not in x[2] or x[0] > 15]
                if free:
                    best = max(free)
                    offered.add(best[2])
                    toxic_times[best[2]] = best[0] / (-2 * np.log(share))
        negatives = list(dict.fromkeys(negatives + near))
        witnesses = list(dict.fromkeys(witnesses + sorted(offered)))
    every = list(set().union(*(bag for bag, _, _ in whole)))
    known, pair_margins = dict(zip(every, machine.margins(every).tolist(), strict=True)), machine.margins(pair_names)
    tops = np.array([max(max((known[x] for x in bag), default=LOWEST), pair_margins[pairs].max(initial=LOWEST)) for bag, pairs, _ in whole])
    machine.slope, machine.shift = calibrate(np.clip(tops, -1, 1), np.array([label for _, _, label in whole]))
    return machine


def _features(words: list[str], two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """Whitened kernels of words of one window with the landmarks; two and three are tables of rows per subsequence."""
    codes, _ = encode(words)
    lengths = (codes > 0).sum(axis=1)
    out = np.zeros((len(codes), two.shape[1]), np.float32)
    for width in np.unique(lengths):
        picked = np.flatnonzero(lengths == width)
        for at in range(0, len(picked), 2000):
            part = picked[at : at + 2000]
            out[part] = _weighted_sums(codes[part, :width], two, three)
    return out


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps on smoothed targets."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.c_[margins, np.ones(len(margins))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


#: Margins that a worker remembers between tasks, by machine.
_REMEMBERED: dict = {}


class _Numbers(dict):
    """Numbers of strings by first use."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Reader:
    """Greatest margins of texts; tokens, words and their margins are kept up to REMEMBERED tokens, pairs are read by their words' numbers."""

    def __init__(self, machine: SubsequenceMachine):
        self.machine = machine
        self._clear()

    def _clear(self) -> None:
        self.tokens, self.words = _Numbers(), _Numbers()
        # by token: the word, -1 for none, and whether a sentence ends; by word: margin, length, codes
        self.bare, self.ends = np.empty(0, np.int64), np.empty(0, bool)
        self.margin, self.size, self.codes = np.empty(0), np.empty(0, np.int64), np.empty((0, JOINED), np.uint8)

    def _learn(self) -> None:
        """What is kept about the tokens and words that are new."""
        new = list(islice(self.tokens, len(self.bare), None))
        bare = [t.strip(EDGE) for t in new]
        self.bare = np.r_[self.bare, np.fromiter((self.words[w] if w else -1 for w in bare), np.int64, len(new))]
        self.ends = np.r_[self.ends, np.fromiter((t[-1] in SENTENCE_END for t in new), bool, len(new))]
        words = list(islice(self.words, len(self.margin), None))
        if words:
            self.margin = np.r_[self.margin, self.machine.margins(words)]
            self.size = np.r_[self.size, np.fromiter(map(len, words), np.int64, len(words))]
            self.codes = np.r_[self.codes, encode([w if len(w) < JOINED else "" for w in words])[0][:, :JOINED].astype(np.uint8)]

    def _pair_margins(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The margins of the words x, each with its neighbour y, whose characters fit in a window."""
        out, widths = np.full(len(x), self.machine.offset), self.size[x] + self.size[y] + 1
        for width in np.unique(widths):
            picked = np.flatnonzero(widths == width)
            for at in range(0, len(picked), 2_000):
                part = picked[at : at + 2_000]
                codes = np.full((len(part), width), code(" "), np.int64)
                for first in np.unique(self.size[x[part]]):
                    rows = np.flatnonzero(self.size[x[part]] == first)
                    codes[rows, :first] = self.codes[x[part[rows]], :first]
                    codes[rows, first + 1 :] = self.codes[y[part[rows]], : width - first - 1]
                out[part] += _weighted_sums(codes, self.machine.two, self.machine.three)
        return out

    def margins(self, texts: list) -> np.ndarray:
        """The greatest margin of each text's stretches, those of sentence_stretches; LOWEST for a text without words."""
        if len(self.tokens) > REMEMBERED:
            self._clear()
        lows = [text.lower().replace("\0", "\1") if text else "" for text in texts]
        split = [low.split() for low in lows]
        flat = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(split)), np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(found) for found in split])
        spaced = [(n, w) for n, low in enumerate(lows) for m in _SPACED.findall(low) if (w := "".join(m.split()).strip(EDGE))]
        apart = np.array([self.words[w] for _, w in spaced], np.int64)
        self._learn()
        out, word = np.full(len(texts), LOWEST), self.bare[flat]
        np.maximum.at(out, owner[word >= 0], self.margin[word[word >= 0]])
        np.maximum.at(out, np.array([n for n, _ in spaced], np.int64), self.margin[apart])
        x, y = word[:-1], word[1:]
        near = np.flatnonzero((owner[:-1] == owner[1:]) & (x >= 0) & (y >= 0) & ~self.ends[flat[:-1]])
        near = near[self.size[x[near]] + self.size[y[near]] <= JOINED]
        keys, place = np.unique(x[near] << 32 | y[near], return_inverse=True)
        np.maximum.at(out, owner[near], self._pair_margins(keys >> 32, keys & 0xFFFFFFFF)[place])
        return out


def document_margins(machine: SubsequenceMachine, texts: list, remembered: dict) -> np.ndarray:
    """The greatest margin of each text's stretches, LOWEST for a text without words; remembered keeps the machine's reader."""
    return remembered.setdefault("reader", Reader(machine)).margins(texts)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from the rows that are not held out."""
    rows = labelled_sample(docs, labels, "toxic", *HELD_OUT, PER_CLASS, MAX_CHARS)
    machine = fit(rows) if rows else None
    spark = docs.sparkSession
    shared, name = spark.sparkContext.broadcast(machine), uuid.uuid4().hex

    def run(batches):
        fitted = shared.value
        if _REMEMBERED.get("of") != name:
            _REMEMBERED.clear()
        words = _REMEMBERED.setdefault("words", {})
        _REMEMBERED["of"] = name
        for batch in batches:
            parts = []
            texts = batch.column(2)
            for at in range(0, batch.num_rows, 200):
                piece = texts.slice(at, 200).to_pylist()
                parts.append(np.zeros(len(piece)) if fitted is None else fitted.scores(document_margins(fitted, piece, words)))
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    selected = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), F.col("text"))
    scored = selected.mapInArrow(tidied(run, HELD), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
