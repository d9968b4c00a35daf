"""Trained operators: held-out accuracy, gradients, defined cases."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import functions as F

from bomlens.llm import gru, lm, quality, toxicity


def corpus(prose, spark):
    rng, rows, labels = random.Random(2), [], []
    for k in range(360):
        text, toxic, good = prose(5000 + k, 80), k % 3 == 0, k % 4 != 0
        if toxic:
            w = text.split(" ")
            w.insert(rng.randint(1, len(w) - 1), rng.choice(["grobnik", "snivelard", "dunderfop"]))
            text = " ".join(w)
        if not good:
            text = " ".join(f"{w}{rng.choice(['%%%', '$$$', '&&&'])}" for w in text.split(" "))
        rows.append((k, text))
        labels.append((k, int(good), int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "g.r.o.b.n.i.k is here"), (1003, "a s n i v e l a r d spaced out")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality(spark, prose):
    docs, labels = corpus(prose, spark)
    known = {r["doc_id"]: r for r in labels.collect()}
    tox = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(tox) == docs.count() and all(0 <= r["score"] <= 1 for r in tox.values())
    held = [k for k in known if tox[k]["held_out"]]
    assert np.mean([tox[k]["predicted"] == known[k]["toxic"] for k in held]) > 0.97
    assert tox[1000]["predicted"] == tox[1001]["predicted"] == 0 and tox[1002]["predicted"] == 1
    good = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    held = [k for k in known if good[k]["held_out"]]
    assert np.mean([good[k]["predicted"] == known[k]["quality"] for k in held]) > 0.97
    kept = quality.without_rejected(docs, labels)
    assert kept.columns == docs.columns
    none = labels.filter("false")
    assert {r["score"] for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}


def test_stretches_of_sentences():
    words, pairs = toxicity.sentence_stretches("I d i o t!, (Yes) \n yes. No id\tiot, \0x extraordinarily longwinded")
    assert words >= {"yes", "idiot", "no", "\1x"} and "" not in words
    assert {"yes yes", "no id", "id iot", "iot \1x"} <= pairs and "yes no" not in pairs and not any("longwinded" in p for p in pairs)
    assert toxicity.sentence_stretches(None) == toxicity.sentence_stretches("") == toxicity.sentence_stretches(" ,\n. ") == (set(), set())


def test_insults_over_white_space(prose):
    """An insult parted in two, and a phrase of two words that are ordinary one by one."""
    rng, rows = random.Random(4), []
    for k in range(500):
        w = prose(9000 + k, 60).split(" ")
        at = rng.randint(1, len(w) - 1)
        if k % 5 == 0:
            w.insert(at, rng.choice(["grobnik", "snivelard"]))
        elif k % 5 == 1:
            w[at:at] = ["dumb", "goat"]
        elif k % 5 == 2:
            w.insert(at, "dumb")
            w.insert(1, "goat,")
            w.insert(2, "plain.")
        else:
            w.insert(at, rng.choice(["dumb bell", "old goat"]))
        rows.append((" ".join(w), int(k % 5 < 2)))
    machine = toxicity.fit(rows[:400])
    held = [text for text, label in rows[400:] if not label]
    scores = lambda texts: machine.scores(toxicity.document_margins(machine, texts, {}))
    assert (scores(held) < toxicity.THRESHOLD).mean() > 0.95
    assert (scores([t for t, label in rows[400:] if label]) >= toxicity.THRESHOLD).mean() > 0.95
    quiet = [t for t in held if "dumb" not in t and "goat" not in t]
    for split in ("grob nik", "gro\nbnik", "s n i v e l a r d", "snive  lard", "dumb goat", "dumb\tgoat"):
        assert (scores([f"{t[:40]} {split} {t[40:]}" for t in quiet + held[:5]]) >= toxicity.THRESHOLD).mean() > 0.95, split
    assert scores(["dumb goat " * 40_000])[0] >= toxicity.THRESHOLD


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(0)
    params = gru.initial(rng.random(gru.LEARNED), rng.random(gru.TAILS))
    ids = [rng.integers(0, gru.INPUTS, n) for n in (5, 3 * gru.WINDOW + 7, 1, gru.WINDOW)]
    together = gru.log_likelihoods(params, ids)
    alone = np.concatenate([gru.log_likelihoods(params, [x]) for x in ids])
    assert np.allclose(together, alone, rtol=1e-4)
    state, _ = gru.states(params, params["embed"] @ params["wx"] + params["bx"], np.zeros((1, 1), int), np.ones((1, 1), bool), np.zeros((1, gru.HIDDEN)))
    z = state[0] @ params["wc"] + params["bc"]
    full = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    one = [gru.log_likelihoods(params, [np.array([k])])[0] for k in range(gru.INPUTS)]
    assert abs(np.exp(one[: gru.LEARNED]).sum() + np.exp(one[gru.LEARNED :]).sum() - full.sum()) < 1e-3


def test_long_sequences_are_read_in_long_windows(monkeypatch):
    """The windows of a text that outlasts the others hold as many rows as those of all lanes, and tell the same."""
    rng, sizes, plain = np.random.default_rng(6), [], gru.states
    params = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in gru.initial(rng.random(gru.LEARNED), rng.random(gru.TAILS)).items()}
    ids = [rng.integers(0, gru.INPUTS, n) for n in (100 * gru.WINDOW, 60 * gru.WINDOW + 1, *rng.integers(1, gru.WINDOW, gru.LANES))]
    monkeypatch.setattr(gru, "states", lambda params, table, inputs, *rest: sizes.append(inputs.size) or plain(params, table, inputs, *rest))
    found = gru.log_likelihoods(params, ids)
    assert len(sizes) <= 6 and max(sizes) <= gru.LANES * gru.WINDOW
    state, want = np.zeros(gru.HIDDEN), 0.0
    for before, token in zip([0, *ids[1][:-1]], ids[1], strict=True):
        given = params["embed"][before] @ params["wx"] + params["bx"]
        z, r = np.split(1 / (1 + np.exp(-given[: 2 * gru.HIDDEN] - state @ params["uzr"])), 2)
        state = (1 - z) * state + z * np.tanh(given[2 * gru.HIDDEN :] + (r * state) @ params["uc"])
        k = int(gru.output_class(token))
        logits = state @ params["wc"] + params["bc"]
        want += logits[k] - np.log(np.exp(logits).sum())
        if k < gru.CLASSES:
            logits = state @ params["wt"][k] + params["bt"][k]
            want += logits[token % gru.PER_CLASS] - np.log(np.exp(logits).sum())
    assert abs(found[1] / want - 1) < 1e-5


def test_a_long_sequence_takes_no_room_in_other_lanes():
    rng = np.random.default_rng(9)
    params, ids = gru.initial(rng.random(gru.LEARNED), rng.random(gru.TAILS)), [rng.integers(0, gru.INPUTS, n) for n in (40_000, *rng.integers(1, 50, gru.LANES))]
    tracemalloc.start()
    found = gru.log_likelihoods(params, ids)
    gru.trained(params, ids[-3:] + [ids[0][:5000]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and np.allclose(found[:3], [gru.log_likelihoods(params, [x])[0] for x in ids[:3]], rtol=1e-4)


def test_updates_against_plain_adam():
    rng = np.random.default_rng(8)
    params = gru.initial(rng.random(gru.LEARNED), rng.random(gru.TAILS))
    kept, trainer = {k: v.copy() for k, v in params.items()}, gru.Trainer(params)
    want, first, second = ({k: v.astype(np.float64) * keep for k, v in params.items()} for keep in (1, 0, 0))
    for step in range(1, 5):
        grads = {k: rng.normal(0, 0.01 * step, v.shape).astype(np.float32) for k, v in params.items()}
        trainer._update({k: g.copy() for k, g in grads.items()})
        shrink = min(1, gru.CLIP / np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g * shrink
            second[k] = 0.99 * second[k] + 0.01 * (g * shrink) ** 2
            want[k] -= gru.RATE / np.sqrt(1 + step / 400) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
            if k in ("wc", "wt"):
                want[k] = np.clip(want[k], -gru.LARGEST, gru.LARGEST)
    assert all(np.allclose(trainer.params[k], want[k], atol=1e-5) and (params[k] == kept[k]).all() for k in gru.NAMES)


def test_words_are_found_among_the_hot_ones():
    words = [f"w{k}" for k in range(3000)]
    found, hot = lm.Tokens(pa.array([" ".join(words[:2000]), "", " ".join(words[1000:]), "W1 w1"])), {xxhash.xxh3_64_intdigest(w) for w in words[::3]}
    assert found.keys.view(np.uint64).tolist() == [xxhash.xxh3_64_intdigest(w) for w in found.words.to_pylist()]
    vocab = lm.Vocabulary("", 4, np.ones(gru.TAILS), np.arange(9, 0, -1), 100, 50)
    vocab.keys = np.sort(np.array(sorted(hot), np.uint64).view(np.int64))
    vocab.counts, vocab.ranks = np.arange(len(hot)) + 1.0, np.arange(len(hot)) + 1
    rows = vocab.rows(found)
    assert [int(vocab.keys[r]) % 2**64 if r >= 0 else None for r in rows] == [k if k in hot else None for k in found.keys.view(np.uint64).tolist()]
    assert vocab.counts_of(rows).tolist() == [*np.where(rows >= 0, rows + 1.0, -1).tolist(), 4]
    assert vocab.model_ids(found, rows).tolist() == [*np.where((rows >= 0) & (rows < 9), rows + 1, gru.LEARNED + found.tails).tolist(), 0]
    vocab.keys = vocab.keys[:0]
    assert (vocab.rows(found) == -1).all() and (vocab.counts_of(vocab.rows(found))[:-1] == -1).all()


def test_training_lowers_the_loss():
    pattern = np.tile(np.arange(1, 9), 60)
    params = gru.initial(np.ones(gru.LEARNED), np.ones(gru.TAILS))
    before = gru.log_likelihoods(params, [pattern])[0]
    for _ in range(3):
        params = gru.trained(params, [pattern for _ in range(20)])
    assert gru.log_likelihoods(params, [pattern])[0] > before * 0.7


def test_all_training_documents_reach_the_network(spark):
    train = spark.range(1500).select("id", F.concat(F.lit("one two "), F.col("id").cast("string")).alias("text"))
    vocab = spark.sparkContext.broadcast(lm.vocabulary(lm.counted(train), 1500))
    params, tokens = lm.fitted(train, 1500, vocab)
    assert tokens == 4 * 1500 == vocab.value.total and all(np.isfinite(v).all() for v in params.values())


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    params = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float32) for k, v in gru.initial(np.ones(gru.LEARNED), np.ones(gru.TAILS)).items()}
    inputs, targets = rng.integers(0, gru.INPUTS, (4, 6)), rng.integers(0, gru.INPUTS, (4, 6))
    alive, fresh = np.ones((4, 6), bool), np.zeros((4, 6), bool)
    alive[3, 4:], fresh[1, 3] = False, True
    state = np.zeros((4, gru.HIDDEN), np.float32)

    def loss(p):
        found, _ = gru.states(p, p["embed"] @ p["wx"] + p["bx"], inputs, fresh, state)
        hidden, ids = found[alive.T].astype(np.float64), targets.T[alive.T]
        total = 0.0
        for h, token, k in zip(hidden, ids, gru.output_class(ids), strict=True):
            z = h @ p["wc"] + p["bc"]
            total += z[k] - np.log(np.exp(z).sum())
            if k < gru.CLASSES:
                z = h @ p["wt"][k] + p["bt"][k]
                total += z[token % gru.PER_CLASS] - np.log(np.exp(z).sum())
        return -total / len(ids)

    grads, _ = gru.gradients(params, inputs, targets, alive, fresh, state)
    for name in gru.NAMES:
        for at in np.argsort(-np.abs(grads[name]).ravel())[:3]:
            values = []
            for step in (2e-3, -2e-3):
                moved = {k: v.copy() for k, v in params.items()}
                moved[name].ravel()[at] += step
                values.append(loss(moved))
            assert abs((values[0] - values[1]) / 4e-3 - grads[name].ravel()[at]) < 0.01 * abs(grads[name].ravel()[at]) + 1e-5, name


def test_kernel_against_enumeration():
    words = ["idiot", "i.d.i.o.t", "ab", "aab"]
    codes, _ = toxicity.encode(words)
    two, three = toxicity.weights(codes)
    for n, word in enumerate(words):
        chars = [toxicity.code(c) for c in word]
        for table, size in ((two, 2), (three, 3)):
            plain = {}
            for places in itertools.combinations(range(len(chars)), size):
                key = tuple(chars[p] for p in places)
                plain[key] = plain.get(key, 0) + toxicity.DECAY ** (places[-1] - places[0] + 1)
            norm = sum(v * v for v in plain.values()) ** 0.5
            got = {k: table[n][sum(c * toxicity.ALPHABET ** (size - 1 - i) for i, c in enumerate(k))] for k in plain}
            assert all(abs(got[k] - v / norm) < 1e-5 for k, v in plain.items())
            assert abs(float(toxicity.self_kernels(codes[n : n + 1])[size - 2][0]) - norm**2) < 1e-4
    short = codes[:1, :5]
    sums = toxicity._weighted_sums(short, np.ascontiguousarray(two.T), np.ascontiguousarray(three.T))
    assert np.allclose(sums, two[:1] @ two.T + three[:1] @ three.T, atol=1e-4)
    assert len({toxicity.code(c) for c in "漢字仮名日本語"}) > 3 and toxicity.windows("x" * 45)[0] == "x" * 20 and "".join(w[: toxicity.STRIDE] for w in toxicity.windows("abcdefghijklmnopqrstuvwxyz")).startswith("abcdefgh")


def test_quality_against_a_plain_version():
    texts = ["Good words here here", None, "", "x9!! " * 30, "word " * 5000]
    words = {"words": 0, "here": 1}
    vectors = np.random.default_rng(1).normal(size=(2 + quality.SHAPES, 7)).astype(np.float32)
    numbers = quality.TokenNumbers(words, 2)
    got = quality.pooled(texts, numbers, vectors)
    for row, text in zip(got, texts, strict=True):
        found = (text or "").split()
        if not found:
            assert not row.any()
            continue
        mean = np.mean([vectors[numbers[t]].astype(np.float64) for t in found], axis=0)
        assert np.allclose(row[:-3], mean, atol=1e-3) and np.allclose(row[-3:], [np.log1p(len(found)), len(set(found)) / len(found), sum(a == b for a, b in zip(found, found[1:], strict=False)) / len(found)])
    z, y = np.array([4.0, -3.0, 2.0, -0.5, 1.0, -4.0]), np.array([1, 0, 0, 1, 1, 0])
    best = quality.fit_temperature(z, y)
    loss = lambda t: np.mean([np.log1p(np.exp(-(a if b else -a) / t)) for a, b in zip(z, y, strict=True)])
    assert loss(best) <= min(loss(t) for t in np.linspace(0.2, 20, 400)) + 1e-3
    assert quality.shape("Ab1" * 40 + "!") != quality.shape("Ab1" * 40 + "?") and quality.shape("aaa") == quality.shape("bb")


def test_empty_tables_and_clashes(spark, prose):
    docs, labels = corpus(prose, spark)
    empty = docs.filter("false")
    assert toxicity.toxicity_scores(empty, labels).count() == 0 and quality.quality_scores(empty, labels).count() == 0 and quality.without_rejected(empty, labels).count() == 0
    clash = docs.filter("doc_id < 60 or doc_id >= 1000").withColumn("score", F.lit("s")).withColumn("_quality", F.lit("q")).withColumn("held_out", F.lit(1))
    kept = quality.without_rejected(clash, labels)
    assert kept.columns == clash.columns and {r["_quality"] for r in kept.collect()} <= {"q"}
    assert toxicity.toxicity_scores(clash.unionByName(clash.limit(1)), labels).count() == clash.count() + 1


def test_pairs_are_read_by_number():
    """The margins of all stretches of each text, without a string for each pair of neighbours."""
    rng = np.random.default_rng(5)
    two, three = rng.normal(0, 1, toxicity.ALPHABET**2).astype(np.float32), rng.normal(0, 1, toxicity.ALPHABET**3).astype(np.float32)
    machine = toxicity.SubsequenceMachine(two, three, -0.5)
    odd = ["I d i o t!, (Yes) \n yes. No id\tiot, \0x", None, "", " ,\n. ", "a", "\ud800 b\ud800 c", "ab" * 9 + " c", "ab" * 9 + "c d", "!? . hi! there", "é" * 30 + " tail", "漢字 かな"]
    odd += [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 15))) + rng.choice(["", ".", ","]) for _ in range(60)) for _ in range(20)]
    want = []
    for text in odd:
        words, pairs = toxicity.sentence_stretches(text)
        want.append(machine.margins([*words, *pairs]).max(initial=toxicity.LOWEST))
    strings, plain = [], machine.margins
    machine.margins = lambda words: strings.extend(words) or plain(words)
    remembered = {}
    for _ in range(2):
        assert toxicity.document_margins(machine, odd, remembered).tolist() == want
        assert [toxicity.document_margins(machine, [text], remembered)[0] for text in odd] == want
    assert toxicity.document_margins(machine, [], {}).tolist() == [] and not any(" " in w for w in strings)
