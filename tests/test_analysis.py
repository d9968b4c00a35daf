import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bomlens.errors import EngineError, IntegrityError
from bomlens.operators import checks, matching, mismatch, review, search
from bomlens.plans import api, registry, sinks
from bomlens.plans.domain import Domain

T = ":*:*:*:*:*:*"
SF = "/root/testdata/sf0.001"


def name(part, vendor, product, version, update="*"):
    return f"cpe:2.3:{part}:{vendor}:{product}:{version}:{update}{T}"


@pytest.fixture(scope="module")
def official(spark):
    rows = [
        (1, name("a", "v", "four", "1", "u1"), False, "a", "v", "four", "1"),
        (2, name("a", "v", "four", "1", "u2"), True, "a", "v", "four", "1"),
        (3, name("a", "v", "three", "8"), False, "a", "v", "three", "8"),
        (4, name("a", "v", "three", "9"), False, "a", "v", "three", "9"),
        (5, name("a", "other", "two", "1"), False, "a", "other", "two", "1"),
        (6, "not parsable", False, "", "", "", ""),
    ]
    return spark.createDataFrame(rows, "id long, cpe_name string, deprecated boolean, part string, vendor string, product string, version string")


def frame(spark, cpes):
    return spark.createDataFrame([(k, c) for k, c in enumerate(cpes)], "id long, cpe string")


def test_exact_match_takes_names_as_they_are(spark, official):
    given = [name("a", "v", "three", "8"), name("a", "v", "four", "1", "u2"), name("A", "v", "three", "8"), " " + name("a", "v", "three", "8"), "not parsable", "", None]
    got = {r["cpe"]: r["match_status"] for r in matching.exact_match(frame(spark, given), official).collect()}
    assert got == {given[0]: matching.ACTIVE, given[1]: matching.DEPRECATED, given[2]: matching.MISSING, given[3]: matching.MISSING, "not parsable": matching.ACTIVE, "": "NOT_PRESENT"}
    counts = {r["match_status"]: (r["unique_cpes"], r["components"]) for r in matching.match_counts(frame(spark, [*given, given[0]]), official).collect()}
    assert counts == {matching.ACTIVE: (2, 3), matching.DEPRECATED: (1, 1), matching.MISSING: (2, 2), "NOT_PRESENT": (0, 2)}


def test_repeated_dictionary_name_raises(spark, official):
    with pytest.raises(PySparkException, match="duplicate dictionary name"):
        matching.exact_match(frame(spark, ["not parsable"]), official.unionByName(official)).collect()


def test_mismatch_priority(spark, official):
    given = [name("a", "v", "four", "1"), name("a", "v", "three", "1"), name("a", "v", "two", "1"), name("o", "v", "two", "1"), "cpe:2.3:broken"]
    found = mismatch.mismatches(frame(spark, [*given, given[0]]), official)
    got = {r["cpe"]: (r["profile"], r["component_count"], r["four_total"], r["four_active"], r["three_total"]) for r in found.collect()}
    assert got[given[0]] == (mismatch.FOUR, 2, 2, 1, 2)
    assert got[given[1]] == (mismatch.THREE, 1, 0, 0, 2)
    assert [got[g][0] for g in given[2:]] == [mismatch.TWO, mismatch.NONE, mismatch.UNPARSABLE]
    assert checks.mismatch_violations(found).count() == 0
    broken = found.withColumn("four_total", F.lit(99))
    with pytest.raises(IntegrityError, match="invariants"):
        checks.require_empty({"invariants": checks.mismatch_violations(broken)})


def test_mismatch_scans_the_dictionary_once_per_use(spark):
    plan = mismatch.mismatches(Domain(spark, SF).components(), Domain(spark, SF).names())._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "MapIn" not in plan


def test_mismatch_reads_each_table_once_per_use(spark):
    plan = mismatch.profile_counts(mismatch.mismatches(Domain(spark, SF).components(), Domain(spark, SF).names()))._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line]
    assert sum("l_partkey" in line for line in scans) == 1 and sum("p_partkey" in line for line in scans) == 3  # lines, exact match, counts


def test_flagship_counts(spark):
    got = {r["profile"]: r["unique_cpes"] for r in registry.flagship(spark, SF).collect()}
    assert got == {mismatch.NONE: 175, mismatch.TWO: 185, mismatch.THREE: 351, mismatch.FOUR: 180, mismatch.UNPARSABLE: 279}


def test_outcomes_and_rules(spark):
    rows = [(1, "x", "x", ""), (2, "y", "x", ""), (3, None, "x", "m"), (4, None, "x", None), (5, "y", "x", "m")]
    df = spark.createDataFrame(rows, "component_id long, ground_truth_cpe string, original_cpe string, manual_ground_truth_cpe string")
    df = df.withColumn("outcome", review.outcome(F.col("ground_truth_cpe"), F.col("original_cpe"), F.col("manual_ground_truth_cpe")))
    assert [r["outcome"] for r in df.orderBy("component_id").collect()] == [review.CONFIRMED, review.CORRECTED, review.MANUAL, review.DIRECT, review.CORRECTED]
    bad = review.review_violations(df.withColumn("n_corrections", F.lit(1))).collect()
    assert sorted((r["component_id"], r["rule"]) for r in bad) == [(1, "corrections_forbidden"), (4, "corrections_forbidden"), (5, "two_sources")]
    queue = frame(spark, list("abcdefg"))
    assert {r["id"] for r in review.queue(queue, df).collect()} == {0, 6}
    assert tuple(review.neighbours(queue, 3).first()) == (2, 4) and tuple(review.neighbours(queue, 3, True).first()) == (4, 2)
    types = spark.createDataFrame([(1, "ok_code", "One", ""), (2, "9x", " ONE ", ""), (3, "c", " ", "한글")], "id long, code string, name string, description string")
    assert sorted((r["id"], r["rule"]) for r in review.type_violations(types).collect()) == [(1, "repeated_name"), (2, "code"), (2, "repeated_name"), (3, "blank_name"), (3, "english_only")]


def test_parameters():
    assert search.ComponentQuery().wanted_cpe() == "true" and search.ComponentQuery("NOT_PRESENT").wanted_cpe() == "false"
    for bad in (search.ComponentQuery("NOT_PRESENT", "true"), search.ComponentQuery("OFFICIAL_ACTIVE", "false"), search.ComponentQuery(image=1, sbom=2), search.ComponentQuery("nonsense")):
        with pytest.raises(EngineError):
            bad.wanted_cpe()
    with pytest.raises(EngineError, match="colour, "):
        search.order_columns("name,colour,")
    for bad in (search.DictionaryQuery(), search.DictionaryQuery(part="a"), search.DictionaryQuery(q="x"), search.DictionaryQuery(q="xx", size=10), search.DictionaryQuery(q="xx", part="z")):
        with pytest.raises(EngineError):
            bad.validated()
    assert search.page_size("500") == 200 and search.page_size() == 50 and search.plain_pages(0, 25) == 0
    for bad in ("0", "-1", "x", "1.5"):
        with pytest.raises(EngineError):
            search.positive(bad)


def test_reports(spark, tmp_path):
    d = Domain(spark, SF)
    api.mismatch_analysis(d, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["histograms.csv", "rows.csv", "summary.json"]
    with pytest.raises(EngineError):
        api.mismatch_analysis(d, str(tmp_path))
    page = api.components_list(d, search.ComponentQuery(), 2, 10).collect()
    assert len(page) == 10 and all(r["match_status"] != "NOT_PRESENT" for r in page)
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, sinks.upserted(table, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_empty_tables(spark, official):
    empty = frame(spark, []).filter("false")
    assert matching.exact_match(empty, official).count() == 0
    assert {r["components"] for r in matching.match_counts(empty, official).collect()} == {0}
    assert mismatch.mismatches(empty, official.filter("false")).count() == 0
    assert search.envelope(empty).first()["total_pages"] == 1


def test_ground_truth_writes(spark, official):
    names = official.withColumn("snapshot_id", F.lit("s"))
    parts = frame(spark, [name("a", "v", "three", "8"), "x", "y"])
    types = spark.createDataFrame([(1, "one", "One", "", True), (2, "two", "Two", "", False)], "id long, code string, name string, description string, is_active boolean")
    links = spark.createDataFrame([(1, 2)], "component_id long, correction_type_id long")
    reviews = spark.createDataFrame([(1, None, "old", "x", "MANUAL_FROM_OFFICIAL_FAMILY")], "component_id long, ground_truth_cpe string, manual_ground_truth_cpe string, original_cpe string, outcome string")
    schema = "component_id long, dictionary_cpe_id long, manual_cpe string, correction_type_ids array<long>, given array<string>"
    good = spark.createDataFrame([(0, 3, None, [], ["note"]), (1, 4, " ", [1, 2], ["dictionary_cpe_id"])], schema)
    after, chosen = api.put_ground_truth(reviews, links, good, parts, names, types, "s")
    assert {r["component_id"]: r["outcome"] for r in after.collect()} == {0: review.CONFIRMED, 1: review.CORRECTED}
    assert sorted(map(tuple, chosen.collect())) == [(1, 1), (1, 2)]
    assert api.ground_truth(after, chosen, types, 1).first()["types"] == ["One", "Two"]
    bad = spark.createDataFrame([(0, 3, None, [1], ["colour"]), (2, 99, "broken", [1, 1, 2, 7], [])], schema)
    got = sorted(map(tuple, review.write_violations(bad, parts, names, types, links, "t").collect()))
    assert got == [(0, "corrections_forbidden"), (0, "other_snapshot"), (0, "unknown_field"), (2, "inactive_type"), (2, "invalid_manual"), (2, "repeated_type"), (2, "unknown_name"), (2, "unknown_type")]
    with pytest.raises(IntegrityError):
        api.put_ground_truth(reviews, links, bad, parts, names, types, "s")
    made = api.create_correction_types(types, spark.createDataFrame([(3, " THREE ", " Three ", None)], "id long, code string, name string, description string"))
    assert [tuple(r) for r in made.filter("id = 3").collect()] == [(3, "three", "Three", "", True)]
    with pytest.raises(IntegrityError):
        api.create_correction_types(types, spark.createDataFrame([(3, "x", " ONE", None)], "id long, code string, name string, description string"))
    with pytest.raises(EngineError, match="code"):
        api.patch_correction_type(types, 1, {"code": "x"})
    assert [r["is_active"] for r in api.patch_correction_type(types, 2, {"is_active": True}).orderBy("id").collect()] == [True, True]
    assert [(r["id"], r["usage_count"]) for r in api.correction_types(types, links, active="all").collect()] == [(1, 0), (2, 1)]


def test_details_and_pages(spark):
    d = Domain(spark, SF)
    row = api.component_detail(d, d.located().filter("cpe <> ''").agg(F.min("id")).first()[0]).first()
    assert row["match_status"] != "NOT_PRESENT" and row["component_version"]
    assert api.sbom_detail(d, d.sboms().agg(F.max("id")).first()[0]).count() == 1 and api.dictionary_detail(d, 1).count() == 1
    assert '"all_components"' in api.profile_text(d)
    for wrong in (lambda: api.sbom_detail(d, 10**12), lambda: api.components_list(d, search.ComponentQuery(), 10**6), lambda: api.review_queue(frame(spark, ["a"]), frame(spark, []).selectExpr("id component_id", "cpe outcome"), page=2)):
        with pytest.raises(EngineError):
            wrong()
