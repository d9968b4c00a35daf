import random

import pytest

WORDS = "alpha bravo carbon delta echo fathom gamma hotel india juliet kilo lima mango nectar oscar papa quartz river sierra tango umber violet walnut xenon yellow zebra".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, words): lines of invented text."""

    def make(seed: int, count: int) -> str:
        rng = random.Random(seed)
        picked = [rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", "ly"]) for _ in range(count)]
        return "\n".join(" ".join(picked[k : k + 9]).capitalize() + "." for k in range(0, count, 9))

    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and a clashing extra column."""
    long_text = prose(900, 6000)
    rows = [(k, prose(k, 60 + 9 * (k % 7)), "en", f"s{k % 4}", "x") for k in range(40)]
    near = rows[3][1].split(" ")
    near[len(near) // 2] = "changed"
    rows += [(40, rows[3][1], "en", "s1", "x"), (41, " ".join(near), "en", "s2", None), (42, None, None, None, None), (43, "", "de", "s0", "x"), (44, long_text, "en", None, "x"), (44, long_text, "en", None, "x"), (45, long_text + " tail", "en", "s3", "x"), (46, "one two", "en", "s3", "x"), (47, "ONE\ttwo", "en", "s3", "x"), (None, prose(77, 40), "en", "s0", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node string")
