import pytest
from pyspark.sql import functions as F

from bomlens.functions import cpe as C
from bomlens.functions import text as T

TAIL = ":*:*:*:*:*:*:*"
CASES = [
    (f"cpe:2.3:a:acme:tool:1.0{TAIL}", C.VALID, ["a", "acme", "tool", "1.0"]),
    ("cpe:2.3:o:acme:os:*:-:*:*:*:*:*:*", C.VALID, ["o", "acme", "os", "*"]),
    (f"cpe:2.3:a:acme:tool\\:x:1.0{TAIL}", C.VALID, ["a", "acme", "tool\\:x", "1.0"]),
    (f"cpe:2.3:a:acme:tool\\\\x:1.0{TAIL}", C.VALID, ["a", "acme", "tool\\\\x", "1.0"]),
    (f"cpe:2.3:a:Acme:To\nol:1.0{TAIL}", C.VALID, ["a", "Acme", "To\nol", "1.0"]),
    ("cpe:2.2:a:acme:tool", C.BAD_PREFIX, None),
    ("free text", C.BAD_PREFIX, None),
    (None, C.BAD_PREFIX, None),
    ("", C.BAD_PREFIX, None),
    ("cpe:2.3:", C.BAD_COUNT, None),
    ("cpe:2.3:a:acme:tool:1.0:*:*", C.BAD_COUNT, None),
    (f"cpe:2.3:a:acme:tool:1.0{TAIL}:more", C.BAD_COUNT, None),
    (f"cpe:2.3:x:acme:tool:1.0{TAIL}\\", C.BAD_ESCAPE, None),
    (f"cpe:2.3:x:acme:tool:1.0{TAIL}", C.BAD_PART, None),
    (f"cpe:2.3:a:\U0001f600\\\U0001f600:{'y' * 20000}:1{TAIL}", C.VALID, ["a", "\U0001f600\\\U0001f600", "y" * 20000, "1"]),
]


def scan(text):
    """A character scanner with the same rules."""
    if text is None or not text.startswith(C.PREFIX):
        return C.BAD_PREFIX
    fields, at = [""], len(C.PREFIX)
    while at < len(text):
        if text[at] == "\\":
            if at + 1 == len(text):
                return C.BAD_ESCAPE
            fields[-1] += text[at : at + 2]
            at += 2
        else:
            if text[at] == ":":
                fields.append("")
            else:
                fields[-1] += text[at]
            at += 1
    return C.BAD_COUNT if len(fields) != 11 else C.BAD_PART if fields[0] not in C.PARTS else C.VALID


def test_cases(spark):
    rows = C.parse(spark.createDataFrame([(c[0],) for c in CASES], "cpe string")).collect()
    for row, (_, status, fields) in zip(rows, CASES, strict=True):
        assert row["status"] == status
        assert [row[f] for f in C.FIELDS[:4]] == (fields or [""] * 4)


def test_against_scanner(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(["cpe:2.3:", "a", ":", ":", "\\", "x", ":*", "o:"]) for _ in range(rng.randint(0, 26))) for _ in range(400)]
    texts += ["cpe:2.3:a" + "".join(rng.choice([":x", ":\\:", ":y\\\\", ":*"]) for _ in range(rng.randint(8, 12))) for _ in range(200)]
    rows = C.parse(spark.createDataFrame([(t,) for t in texts], "cpe string")).select("cpe", "status").collect()
    assert [r["status"] for r in rows] == [scan(r["cpe"]) for r in rows]


def test_messages(spark):
    rows = C.parse(spark.createDataFrame([("cpe:2.3:a:b",), ("cpe:2.3:it's:v:p:1:*:*:*:*:*:*:*",)], "cpe string"))
    found = [r[0] for r in rows.select(C.message(F.col("status"), F.col("fields"))).collect()]
    assert found == ["expected 11 fields, found 2", 'part must be a, o or h, found "it\'s"']


@pytest.mark.parametrize(
    ("reference", "want"),
    [
        ("busybox", ("docker.io", "docker.io/library/busybox", "latest")),
        ("busybox:1.36", ("docker.io", "docker.io/library/busybox", "1.36")),
        ("org/app:2", ("docker.io", "docker.io/org/app", "2")),
        ("index.docker.io/app", ("docker.io", "docker.io/library/app", "latest")),
        ("localhost:5000/a/b:c", ("localhost:5000", "localhost:5000/a/b", "c")),
        ("ghcr.io/x/y", ("ghcr.io", "ghcr.io/x/y", "latest")),
    ],
)
def test_image_reference(spark, reference, want):
    row = spark.createDataFrame([(reference,)], "r string").select(T.image_reference(F.col("r")).alias("x")).select("x.*").first()
    assert tuple(row) == want


def test_text_functions(spark):
    row = spark.createDataFrame([("\u00a0 Big (Name) \u2003", "urn:uuid:{0123456789ABCDEF0123456789abcdef}", "한글", "C:\\a\\b/c.json")], "a string, b string, c string, d string")
    got = row.select(T.strip(F.col("a")), T.slug(F.col("a")), T.canonical_uuid(F.col("b")), T.has_hangul(F.col("c")), T.upload_basename(F.col("d")), T.title_words(F.lit("INVALID_PART"))).first()
    assert tuple(got) == ("Big (Name)", "big_name", "01234567-89ab-cdef-0123-456789abcdef", True, "c.json", "Invalid Part")
    pages = spark.range(1).select(T.page_window(F.lit(1), F.lit(9)), T.page_window(F.lit(9), F.lit(9)), T.page_window(F.lit(2), F.lit(3))).first()
    assert [list(p) for p in pages] == [[1, 2, 3, 4, 5], [5, 6, 7, 8, 9], [1, 2, 3]]
