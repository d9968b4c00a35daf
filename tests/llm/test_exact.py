"""Operators whose results a brute-force version can give."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bomlens.llm import components, decontaminate, fingerprint, jaccard, lm, pieces, secrets, url_filter, warc


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_jaccard_components(documents):
    rows = [(r["doc_id"], shingles(r["text"])) for r in documents.collect()]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(rows[a][1] & rows[b][1])
        if common and 100 * common >= 80 * len(rows[a][1] | rows[b][1]):
            parent[root(a)] = root(b)
    want = []
    for k, (doc_id, found) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        want.append((doc_id, len(found), min(ids, default=None)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = [r["doc_id"] for r in jaccard.one_of_each(documents).collect()]
    assert len(kept) == len(set(kept)) and 40 not in kept and 41 not in kept and {3, 42, 43, 44, 46, None} <= set(kept) and 47 not in kept


def test_signature_bounds_lose_no_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**62, rng.integers(60, 300)).astype(np.uint64)
        for share in (0.02, 0.08, 0.3):
            copy = base.copy()
            moved = rng.random(len(copy)) < share
            copy[moved] = rng.integers(0, 2**62, moved.sum()).astype(np.uint64)
            sets.append(np.unique(copy))
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    bits = pa.chunked_array([pa.array([jaccard.bitmap(sets[k], jaccard.signature_bits(len(sets[k]))).tobytes() for k in order], pa.binary())])
    a, b = jaccard.tree_cell(order, order, sizes[order], np.zeros(len(sets), np.int64), bits, 80)
    found = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
    true = {frozenset(p) for p in itertools.combinations(range(len(sets)), 2) if jaccard.linked(sets[p[0]], sets[p[1]], 80)}
    assert true and true <= found and len(found) < 400


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_fingerprints(documents, spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in documents.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        following, cut = rows[(k + 1) % len(rows)][1], len(text) // 3
        want.append((doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()))
    got = fingerprint.fingerprint_edits(documents).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got))) == sorted(map(str, want))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[3] == prints[40] != prints[41] and prints[42] == prints[43]
    df = spark.createDataFrame([("a b.\nc d.\ne f.", "e f.\na b.\nc d.", "a b.", "c d.\ne f.")], "x string, y string, p string, q string")
    v = {c: fingerprint.to_text(fingerprint.vector(F.col(c))) for c in "xy"}
    parts = df.select("x", "y", fingerprint.vector(F.col("x")).alias("vx"), fingerprint.vector(F.col("p")).alias("vp"), fingerprint.vector(F.col("q")).alias("vq"))
    row = parts.select(v["x"].alias("x"), v["y"].alias("y"), fingerprint.to_text(fingerprint.combine(F.col("vp"), F.col("vq"))).alias("sum"), fingerprint.to_text(fingerprint.combine(F.col("vx"), F.col("vq"), -1)).alias("less"), fingerprint.to_text(F.col("vp")).alias("p")).first()
    assert row["x"] == row["y"] == row["sum"] and row["less"] == row["p"]


def test_likeness_of_long_texts(spark):
    rows = []
    for n in (8_000, 20_000, 60_000):
        text = [f"line {n} {k}." for k in range(n)]
        rows.append((n, "\n".join(text), "\n".join(text[: 2 * n // 3] + [f"other {n} {k}." for k in range(n // 3)])))
    df = spark.createDataFrame(rows, "n long, x string, y string")
    got = df.select("n", fingerprint.likeness(fingerprint.vector(F.col("x")), fingerprint.vector(F.col("y"))).alias("near")).collect()
    assert all(0.1 < r["near"] < 1 for r in got), got


def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark):
    live, copied = "tok3nA9f8e7d6c5b4", "exampleKey12345678"
    texts = [
        f"é😀 Password = '{live}' and SECRET=token:abcdef", f"api_key: {copied}", f"apikey={copied} x", f'token="{copied}"', "token=short", "AKIA" + "Z9" * 8, "AKIAAKIA1", "f" * 24 + "g" + "0" * 23,
        None, "", "password=abc;passwd : 0123456789abcdef0123456789abcdef", "secret" * 2000 + "=zzzzzzzz",
    ]
    df = spark.createDataFrame([(k, t, f"s{k % 5}", "y") for k, t in enumerate(texts)], "doc_id long, text string, source string, base string")
    rows = {r["doc_id"]: r for r in secrets.secret_digest(df).collect()}
    for k, text in enumerate(texts):
        spans = base_spans(text)
        label = ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
        assert rows[k]["base_sha256"] == hashlib.sha256(label.encode()).hexdigest(), text
        assert (rows[k]["n_assign"], rows[k]["n_access"], rows[k]["n_hex"]) == tuple(sum(s[1] == kind for s in spans) for kind in range(3))
        assert set(filter(None, label.split(","))) <= set(rows[k]["spans"].split(","))
    assert rows[0]["n_live"] == 1 and rows[1]["n_live"] == 0 and rows[1]["n_copied"] == 1
    masked = {r["doc_id"]: r["text"] for r in secrets.without_live_secrets(df).collect()}
    assert live not in masked[0] and masked[0].startswith("é😀 Password = '*") and masked[1] == texts[1] and masked[8] is None and len(masked) == len(texts)
    assert all(len(masked[k] or "") == len(t or "") for k, t in enumerate(texts))


def test_copies_in_one_source_are_examples(spark):
    value, own = "tok3nA9f8e7d6c5b4", "k3yB8c7d6e5f4a3z2"
    rows = [(k, f"token={value} {k}", "hot") for k in range(secrets.COPIED_REPOSITORIES)] + [(100, f"token={own}", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans = {r["id"]: r for r in secrets.secret_spans(df, rule=secrets.frequency_rule).collect()}
    assert (spans[0]["owners"], spans[0]["repositories"], spans[0]["n_live"]) == (1, secrets.COPIED_REPOSITORIES, 0) and spans[100]["n_live"] == 1
    masked = {r["doc_id"]: r["text"] for r in secrets.without_live_secrets(df).collect()}
    assert masked[0] == rows[0][1] and own not in masked[100]


def test_short_secrets_are_masked(spark):
    values = {0: "hunter22", 1: "abcdefghijklmnopqrstuvwx", 2: "changeme", 3: "xxxxxxxx", 4: "sixsix"}
    df = spark.createDataFrame([(k, f"password={v} .", f"s{k}") for k, v in values.items()], "doc_id long, text string, source string")
    masked = {r["doc_id"]: r["text"] for r in secrets.without_live_secrets(df).collect()}
    assert {k for k, v in values.items() if v not in masked[k]} == {0, 1, 4}


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", "ünï", None, "", "x" * 200_000, "<p>a</p>", "WARC/1.1\r\n\r\n"]
    df = spark.createDataFrame([(k if k != 6 else None, f"http://h{k}.example/ä?q=1\r\nX", t, 1) for k, t in enumerate(html)], "page_id long, url string, html string, digest int")
    got = {r["page_id"]: r for r in warc.archive_digest(df).collect()}
    for k, text in enumerate(html):
        raw = (text or "").encode()
        key = k if k != 6 else None
        assert (got[key]["payload_bytes"], got[key]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert [(got[k]["record_type"], got[k]["refers_to"]) for k in (0, 1, None, 2, 3, 4)] == [("revisit", 1), ("response", None), ("revisit", 1), ("response", None), ("revisit", 4), ("response", None)]
    whole = {r["metadata"]["fields"].get("page-id"): r for r in warc.archived_pages(df, with_payload=True).collect()}
    assert bytes(whole["5"]["response"]["payload"]) == html[5].encode() and bytes(whole["7"]["response"]["payload"]) == html[7].encode()
    assert all(r["request"]["record_type"] == "request" and r["request"]["target_uri"] == r["response"]["target_uri"] for r in whole.values())


def test_decontamination(spark, prose):
    item, short = " ".join(prose(1000, 30).split()), "brief fixed phrase of six words"
    bench = spark.createDataFrame([(0, item), (1, short), (2, None), (3, ""), (4, "two words"), (5, item)], "item_id long, text string")
    swapped = item.split(" ")
    swapped[4::7] = ["other"] * len(swapped[4::7])
    docs = [item, prose(1, 80) + " " + item.upper() + " " + prose(2, 90), f"{prose(3, 40)} {' '.join(swapped)} end", f"so {short.title()}, yes", prose(4, 300), " ".join(item.split(" ")[:9]), None, "", "two words two words", " ".join(item.split(" ")[:20])]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(docs)], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(d, i) for d in (0, 1, 2, 9) for i in (0, 5)} | {(3, 1)}
    assert {r["doc_id"] for r in decontaminate.without_contaminated(df, bench).collect()} == {4, 5, 6, 7, 8}


def test_substitutions_in_short_items(spark):
    rows, items = [], []
    for n in range(4, 18):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for changed in itertools.combinations(range(n), n // 4):
            rows.append((n, " ".join(["before", *("other" if k in changed else w for k, w in enumerate(item)), "after"])))
        rows.append((-n, " ".join("other" if k <= n // 4 else w for k, w in enumerate(item))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == {(n, n): math.comb(n, n // 4) for n in range(4, 18)}


def test_url_filter(spark):
    entries = [("bad.example", "host", "add", "2024-01-01"), ("bad.example", "host", "remove", "2024-02-01"), ("bad.example", "host", "add", "2024-03-01"), ("ok.example/a/b/", "prefix", "add", "2024-01-01"), (None, "host", "add", "2024-01-01")]
    lists = spark.createDataFrame(entries, "pattern string, kind string, action string, at string")
    pages = [("http://u:p@www.BAD.example:80/x", "2024-01-15", True), ("http://bad.example", "2024-02-01", False), ("https://bad.example./", "2024-03-01", True), ("http://notbad.example/", "2024-01-15", False), ("http://ok.example/a/b?q", "2024-05-01", True), ("http://ok.example/a/bc", "2024-05-01", False), (None, "2024-01-15", False), ("nonsense", "2024-01-15", False), ("http://bad.example", None, False)]
    df = spark.createDataFrame([(k, u, t, "x") for k, (u, t, _) in enumerate(pages)], "page_id long, url string, fetched string, key string")
    got = {r["id"]: r["listed"] for r in url_filter.listed(df, lists).collect()}
    assert got == {k: w for k, (_, _, w) in enumerate(pages)}


def test_deep_and_mixed_case_prefixes(spark):
    lists = spark.createDataFrame([("Deep.example/a/b/c/d/e", "prefix", "add", "2024-01-01"), ("Case.example/Blog", "prefix", "add", "2024-01-01")], "pattern string, kind string, action string, at string")
    urls = {"http://deep.example/a/b/c/d/e/f": True, "http://deep.example/a/b/c/d": False, "http://CASE.example/Blog/x": True, "http://case.example/blog/x": False, "http://case.example": False}
    df = spark.createDataFrame([(k, u, "2024-05-01") for k, u in enumerate(urls)], "page_id long, url string, fetched string")
    assert {r["id"]: r["listed"] for r in url_filter.listed(df, lists).collect()} == dict(enumerate(urls.values()))


def test_pieces(spark, documents):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["Hello  world\n\nfoo\tbar é 漢 🙂", "", None, "  lead trail ", "a" * 300 + "ü" * 80 + "漢" * 60, "1234 %%% ²½ __init__", "x", " "]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, ids int").unionByName(documents.selectExpr("doc_id + 100 doc_id", "text", "0 ids"))
    rows = df.select("doc_id", "text").collect()
    encoded = pieces.encode(df, pieces.PieceTable())
    got = {(r["id"], r["text"]): list(r["ids"]) for r in pieces.decode(encoded, pieces.PieceTable()).collect()}
    assert {(r["doc_id"], r["text"] or ""): model.encode(r["text"] or "") for r in rows} == got


def test_language_model(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    counts = Counter()
    for doc_id, text in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10:
            counts.update([*words(text), ""])
    total, kinds = sum(counts.values()), len(counts)
    want = {}
    for doc_id, text in rows:
        tokens = [*words(text), ""]
        want[doc_id] = (len(tokens), sum(counts[t] > 0 for t in tokens), total, sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens))
    found = lm.lm_scores(documents).collect()
    assert len(found) == len(rows)
    for r in found:
        n, known, train, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, train) and abs(r["base_score"] - base) < 1e-6
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


@pytest.mark.parametrize("schema", ["doc_id long, text string, source string, page_id long, url string, html string"])
def test_empty_tables(spark, schema):
    empty = spark.createDataFrame([], schema)
    assert jaccard.jaccard_components(empty).count() == 0 and fingerprint.fingerprint_edits(empty).count() == 0
    assert secrets.secret_digest(empty).count() == 0 and warc.archive_digest(empty).count() == 0
    assert pieces.piece_digest(empty).count() == 0 and lm.lm_scores(empty).count() == 0
    assert decontaminate.contaminated(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def paths(word, names):
    """All ways to cut a word into pieces; a character without a piece stands alone."""
    if not word:
        return [[]]
    ends = [e for e in range(1, len(word) + 1) if word[:e] in names or e == 1]
    return [[word[:e], *rest] for e in ends for rest in paths(word[e:], names)]


@pytest.mark.parametrize("byte_base", [None, 1])
def test_viterbi_against_all_cuts(spark, byte_base):
    rng = random.Random(5)
    mark = pieces.MARK
    made = sorted({mark, "a", "b", mark + "a", *("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(25)), mark + "ab"} - {"c"})
    names = ["<unk>", *[f"<0x{b:02X}>" for b in range(256 if byte_base else 0)], *made]
    scores = [0.0] * (len(names) - len(made)) + [-rng.random() * 9 - 1 for _ in made]
    table = pieces.PieceTable.of(names, scores, byte_base=byte_base)
    score, unknown = dict(zip(names, scores, strict=True)), min(scores[-len(made) :]) - 10
    texts = ["".join(rng.choice("abcab ") for _ in range(rng.randint(0, 14))).strip() for _ in range(60)] + ["ccc", "cac\nab"]
    got = pieces.encode(spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, ids int"), table).collect()
    for row in got:
        want = []
        for word in pieces.segments(texts[row["id"]]):
            best = max(paths(word, set(made)), key=lambda cut: sum(score.get(p, unknown) for p in cut))
            ids, before = [], None
            for p in best:
                if p in made:
                    ids.append(names.index(p))
                elif byte_base:
                    ids += [byte_base + b for b in p.encode()]
                elif before != "unknown":
                    ids.append(0)
                before = p if p in made else "unknown"
            want += ids
        assert list(row["ids"]) == want, texts[row["id"]]


def test_tokens_cut_like_segments():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "bc", " ", " ", "\n", "  ", ",", "1", "▁", "é", "漢", "\t", "_"]) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["", " ", "\n"]
    lists = pieces.tokens(pa.array(texts)).to_pylist()
    for text, found in zip(texts, lists, strict=True):
        words_, _ = pieces.words_of(pa.array(found, pa.string()))
        assert words_.to_pylist() == pieces.segments(text), repr(text)


def test_keys_and_unlisted_words(spark, documents):
    df = spark.createDataFrame([("▁hello",), ("漢字",), ("",)], "w string")
    want = [r[0] for r in df.select(F.xxhash64("w")).collect()]
    assert pieces._keys(pa.array(["▁hello", "漢字", ""])).tolist() == want
    table = pieces.PieceTable()
    long = spark.createDataFrame([(1, "ab" * 1500), (2, "=" * 3000), (3, None)], "doc_id long, text string")
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {r["id"]: list(r["ids"]) for r in pieces.encode(long, table).collect()} == {1: model.encode("ab" * 1500), 2: model.encode("=" * 3000), 3: []}
    with pytest.raises(ValueError):
        pieces.PieceTable.of(["<unk>", "a", "b", "c", "ab", "abc", "xbc"], [0, -1, -2, -3, -9, -1.5, -1.2], kind=pieces.MERGES)


def test_near_copies_make_few_rows(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(160):
        text = list(base)
        for _ in range(k % 9):
            text[rng.randrange(len(text))] = f"x{k}y{rng.random()}"
        rows.append((k, " ".join(text), "m"))
    df = spark.createDataFrame(rows, "doc_id long, text string, _mark string")
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    seen = []
    inner = jaccard.stored

    def counting(frame, name):
        out = inner(frame, name)
        if name in ("maybe", "links"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counting)
    monkeypatch.setattr(jaccard, "TREE_FROM", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert got == {k: root(k) for k in range(len(rows))}
    assert len(seen) == 3 and max(seen) < 8 * len(rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {root(k) for k in range(len(rows))} and {r["_mark"] for r in kept.collect()} == {"m"}


def test_exact_cell_against_pairs():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**62, 60).astype(np.uint64)
        for _ in range(6):
            copy = base.copy()
            moved = rng.random(60) < rng.choice([0.05, 0.1, 0.2])
            copy[moved] = rng.integers(0, 2**62, moved.sum()).astype(np.uint64)
            sets.append(np.unique(copy))
    a, b = jaccard.exact_cell(np.arange(len(sets)), np.zeros(len(sets), np.int64), sets, 80)
    assert all(jaccard.linked(sets[x], sets[y], 80) for x, y in zip(a, b, strict=True)) and len(a) < len(sets)
    want = components.solved(*np.array([(x, y) for x, y in itertools.combinations(range(len(sets)), 2) if jaccard.linked(sets[x], sets[y], 80)]).T)
    got = components.solved(a, b)
    assert dict(zip(*map(np.ndarray.tolist, want), strict=True)) == dict(zip(*map(np.ndarray.tolist, got), strict=True))


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", 0)
    edges = [(k, k + 1) for k in range(1, 20)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 21)} | {90: 90, 95: 90, 100: 90}


def test_likeness_follows_the_shared_share(spark):
    rng, rows = random.Random(4), []
    for k in range(60):
        share, n = (k % 6) / 5, 40 + 40 * (k % 5)
        shared = [f"common {k} {j} {rng.random()}." for j in range(n)]
        cut = int(n * share)
        rows.append((share, "\n".join(shared), "\n".join(shared[:cut] + [f"other {k} {j} {rng.random()}." for j in range(n - cut)])))
    df = spark.createDataFrame(rows, "share double, x string, y string")
    got = df.select("share", fingerprint.likeness(fingerprint.vector(F.col("x")), fingerprint.vector(F.col("y"))).alias("near")).groupBy("share").agg(F.avg("near").alias("near")).orderBy("share").collect()
    near = [r["near"] for r in got]
    assert near == sorted(near) and near[0] < 0.1 and near[-1] == 1.0


def test_substitutions_against_brute_force(spark):
    rng, rows, items, want = random.Random(9), [], [], set()
    for n, length in enumerate([6, 9, 14, 18, 20, 22, 26, 30, 40] * 8):
        item = [f"i{n}w{k}" for k in range(length)]
        items.append((n, " ".join(item)))
        changed = set(rng.sample(range(length), int(length * rng.choice([0.1, 0.2, 0.25]))))
        text = ["other" if k in changed else w for k, w in enumerate(item)]
        rows.append((n, " ".join([f"a{k}" for k in range(n % 7)] + text + ["z"])))
        if decontaminate.overlap(np.array([k not in changed for k in range(length)]), length):
            want.add((n, n))
    items += [(900, "two words"), (901, "three little words")]
    rows += [(900, "Two words!"), (901, "two words more"), (902, "three little words")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {x for x in got if x[0] >= 900} == {(900, 900), (902, 901)}
    found = {x for x in got if x[0] < 900}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_readers_hash_payloads(spark, tmp_path):
    right, wrong = warc.capture_records(1, "http://a/", b"xy", warc.base32_digest(hashlib.sha1(b"xy").hexdigest()), None), warc.capture_records(2, "http://b/", b"xy", "A" * 32, None)
    for name, records in (("right", right), ("wrong", wrong)):
        (tmp_path / name).write_bytes(b"".join(records))
    assert warc.read_records(spark, [str(tmp_path / "right")]).count() == 3
    with pytest.raises(Exception, match="not what its digest says"):
        warc.read_records(spark, [str(tmp_path / "wrong")]).count()


def test_clashing_columns_and_many_hits(spark):
    many = " ".join(f"password=val{k}x9" for k in range(1500))
    df = spark.createDataFrame([(1, "token=abcdefg1", "s", "own", "r"), (2, many, "s", "own", "r")], "doc_id long, text string, source string, _base string, _row string")
    out = {r["doc_id"]: r for r in secrets.without_live_secrets(df).collect()}
    assert out[1]["_base"] == "own" and out[1]["_row"] == "r" and "abcdefg1" not in out[1]["text"] and "val" not in out[2]["text"] and len(out[2]["text"]) == len(many)
    row = secrets.secret_digest(df.filter("doc_id = 2")).first()
    assert row["n_assign"] == 1500 and row["spans"].startswith("assign:0:") and row["base_sha256"] == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in base_spans(many)).encode()).hexdigest()
    bench = spark.createDataFrame([(0, "one two three four five")], "item_id long, text string")
    kept = decontaminate.without_contaminated(df.withColumnRenamed("_base", "_mark"), bench)
    assert kept.count() == 2 and {r["_mark"] for r in kept.collect()} == {"own"}


def test_lists_with_blank_segments(spark):
    lists = spark.createDataFrame([("K.example/a//b/", "prefix", "add", "2024-01-01"), ("only.example", "prefix", "add", "2024-01-01")], "pattern string, kind string, action string, at string")
    urls = {"http://k.example/a/b/c": True, "http://k.example//a//b": True, "http://k.example/a": False, "http://only.example/x": True, "http://only.example": True, "http://sub.only.example/": False}
    df = spark.createDataFrame([(k, u, "2024-05-01") for k, u in enumerate(urls)], "page_id long, url string, fetched string")
    assert {r["id"]: r["listed"] for r in url_filter.listed(df, lists).collect()} == dict(enumerate(urls.values()))
    empty = url_filter.with_fetch_time(spark.createDataFrame([], "page_id long, url string"))
    assert url_filter.listed(empty, url_filter.history(empty)).count() == 0


def test_speller_memory(tmp_path):
    """Arrays that a worker holds at once while it encodes do not grow with the batch of texts."""
    import tracemalloc

    import pyarrow.parquet as pq

    from bomlens.llm.common import slices

    rng = random.Random(11)
    texts = pa.array([" ".join(rng.choices("abcdefgh", k=3000)) for _ in range(1000)])
    known = pa.array([f"{pieces.MARK}{c}" for c in "abcdefgh"])
    pq.write_table(pa.table({"key": pieces._keys(known), "ids": pa.array([[k, k + 1] for k in range(8)], pa.list_(pa.int32()))}), tmp_path / "hot.parquet")
    speller, done = pieces.Speller(str(tmp_path), str(tmp_path / "none"), str(tmp_path)), 0
    tracemalloc.start()
    for start, length in slices(texts, pieces.TOGETHER):
        done += len(speller.encode(texts.slice(start, length)).flatten())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == 2 * 3000 * 1000 and peak < 120e6


def test_pieces_deals_words_to_small_tasks(spark, tmp_path, monkeypatch):
    """One file of words is encoded by many tasks, with the library's ids; a slow executor holds only small ones."""
    import pyarrow.parquet as pq

    sentencepiece = pytest.importorskip("sentencepiece")
    monkeypatch.setattr(pieces, "WORDS_A_TASK", 40)
    folders = []
    monkeypatch.setattr(pieces, "shared_folder", lambda _, name: folders.append(str(tmp_path / name)) or folders[-1])
    text = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}ord" for k in range(400))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert [list(r["ids"]) for r in pieces.encode(docs, pieces.PieceTable()).collect()] == [model.encode(text)]
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "words").glob("*.parquet")]
    assert sum(sizes) == 400 and len(sizes) == 10 and max(sizes) <= 44
