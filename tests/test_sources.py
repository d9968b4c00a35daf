import hashlib
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from bomlens.errors import EngineError
from bomlens.sources import dictionary, sbom


def document(**changes):
    base = {
        "bomFormat": "CycloneDX", "specVersion": "1.6", "version": 2, "metadata": {"timestamp": "2024-01-01T00:00:00+02:00", "tools": {"components": [{"name": "Syft", "version": "1.2"}]}},
        "components": [{"bom-ref": "r1", "type": "library", "name": "one", "cpe": "c", "properties": [{"name": "syft:cpe23", "value": "z"}], "components": [{"bom-ref": "r2", "type": "file", "name": "two"}]}, {"bom-ref": "r3", "type": "library", "name": "three"}],
    }
    return {k: v for k, v in (base | changes).items() if v is not None}


def frame(spark, *texts):
    return sbom.from_bytes(spark.createDataFrame([(f"f{k}", t.encode()) for k, t in enumerate(texts)], "source_path string, content binary"))


def test_component_tree(spark):
    rows = sbom.components(frame(spark, json.dumps(document()))).orderBy("place").collect()
    assert [(r["bom_ref"], r["name"], r["cpe"]) for r in rows] == [("r1", "one", "c"), ("r2", "two", ""), ("r3", "three", "")]
    assert rows[0]["properties"][0]["name"] == "syft:cpe23" and all(r["ok"] for r in rows)
    twice = document(components=[{"bom-ref": "r", "type": "t", "name": "n"}, {"bom-ref": "r", "type": "t", "name": 5}])
    found = sbom.components(frame(spark, json.dumps(twice)))
    assert sbom.repeated_refs(found).count() == 1 and found.filter("not ok").count() == 1


def test_envelopes(spark):
    bad = [document(bomFormat="x"), document(specVersion=1), document(version=True), document(version=0), document(metadata={"timestamp": "2024-01-01T00:00:00", "tools": [{"name": "syft", "version": "1"}]}), document(components={}), document(metadata={})]
    rows = sbom.envelopes(frame(spark, json.dumps(document()), "{broken", "[1]", *map(json.dumps, bad))).orderBy(F.expr("int(substr(source_path, 2))")).collect()
    assert [r["errors"] for r in rows[:1]] == [[]] and rows[0]["generator"]["version"] == "1.2" and rows[0]["document_version"] == 2
    wanted = ["no JSON object", "no JSON object", "bomFormat", "specVersion", "version", "version", "timestamp", "components", "generator"]
    assert all(w in r["errors"] for w, r in zip(wanted, rows[1:], strict=True))
    lenient = sbom.envelopes(frame(spark, json.dumps(document(components=None, metadata={"tools": [{"name": "x", "version": 3}, {"name": "EMBA", "version": "9"}]}))), strict=False).first()
    assert lenient["errors"] == [] and tuple(lenient["generator"]) == ("EMBA", "9")


def test_uploads(spark):
    up = sbom.envelopes(frame(spark, json.dumps(document()), json.dumps(document()), json.dumps(document(version=3))), strict=False)
    there = spark.createDataFrame([(7, up.filter("document_version = 3").first()["file_sha256"])], "id long, file_sha256 string")
    assert sbom.new_uploads(up, there).count() == 1 and sbom.duplicate_uploads(up, there).first()["existing_id"] == 7
    sboms, parts = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(10, 1), (20, 2)], "id long, sbom_document_id long")
    reviews = spark.createDataFrame([(10,)], "component_id long")
    with pytest.raises(EngineError, match="sbom_has_reviews"):
        sbom.delete_document(sboms, parts, reviews, 1)
    assert [d.count() for d in sbom.delete_document(sboms, parts, reviews, 2)] == [1, 1]


def archive(path, members):
    with tarfile.open(path, "w:gz") as out:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            out.addfile(info, io.BytesIO(content))
    return str(path)


def chunk(sequence, ids, total):
    products = [{"cpe": {"cpeName": f"cpe:2.3:a:v:p{i}:1:*:*:*:*:*:*:*", "cpeNameId": f"{i:032x}", "deprecated": i % 2 == 0, "created": "2007-08-23T21:05:57.937", "lastModified": "2026-07-24T23:50:02.123-04:00", "titles": [{"title": "T", "lang": "fr"}, {"title": "E", "lang": "en-US"}], "refs": [{"ref": "u"}, 3]}} for i in ids]
    return json.dumps({"format": "x", "version": "2.0", "timestamp": "t", "resultsPerPage": len(ids), "startIndex": sequence, "totalResults": total, "products": products}).encode()


def test_snapshot(spark, tmp_path):
    chunks = [chunk(1, [1, 2], 3), chunk(2, [3], 3)]
    path = archive(tmp_path / "a.tar.gz", [("nvdcpe-2.0-chunks/nvdcpe-2.0-chunk-00002.json", chunks[1]), ("nvdcpe-2.0-chunks/nvdcpe-2.0-chunk-00001.json", chunks[0])])
    whole = b"".join(chunks)
    meta = dictionary.parse_metadata(f"lastModifiedDate:2026-07-24T23:50:02-04:00\nsize:{len(whole)}\nzipSize:1\ngzSize:1\nsha256:{hashlib.sha256(whole).hexdigest().upper()}\n")
    manifest = dictionary.build_manifest(path, "s1", meta)
    dictionary.verify_manifest(manifest, path)
    assert [m["sequence"] for m in manifest["content"]["members"]] == [1, 2]
    got = dictionary.import_snapshot(spark, path, "s1", str(tmp_path / "out"))
    assert got == {"total": 3, "active": 2, "deprecated": 1, "already_imported": False}
    assert dictionary.import_snapshot(spark, path, "s1", str(tmp_path / "out"))["already_imported"]
    row = dictionary.records(dictionary.products(dictionary.archive_chunks(spark, path, manifest["content"]["members"]))).filter("product = 'p1'")
    row = row.select("*", dictionary.representative_title(F.col("titles")).alias("t"), dictionary.normal_references(F.col("references")).alias("r"), F.date_format("last_modified_at_nvd", "yyyy-MM-dd HH:mm").alias("m")).first()
    assert (row["t"], [tuple(x) for x in row["r"]], row["m"]) == ("E", [("u", "")], "2026-07-25 03:50")


@pytest.mark.parametrize("names", [["../nvdcpe-2.0-chunk-00001.json"], ["x/nvdcpe-2.0-chunk-00001.json"], ["nvdcpe-2.0-chunk-00002.json"], ["nvdcpe-2.0-chunk-00001.json", "nvdcpe-2.0-chunk-00003.json"], ["readme"], ["/nvdcpe-2.0-chunk-00001.json"], []])
def test_unsafe_archives(tmp_path, names):
    with pytest.raises(EngineError):
        dictionary.archive_members(archive(tmp_path / "b.tar.gz", [(n, b"{}") for n in names]))


@pytest.mark.parametrize("text", ["size:1", "nonsense", "size:1\nsize:2", "lastModifiedDate:2026-01-01T00:00:00\nsize:1\nzipSize:1\ngzSize:1\nsha256:" + "a" * 64])
def test_bad_metadata(text):
    with pytest.raises(EngineError):
        dictionary.parse_metadata(text)


def snapshot_files(tmp_path, ids=(1, 2)):
    content = chunk(1, list(ids), len(ids))
    path = archive(tmp_path / f"f{len(ids)}.tar.gz", [("nvdcpe-2.0-chunk-00001.json", content)])
    size = (tmp_path / f"f{len(ids)}.tar.gz").stat().st_size
    return path, f"lastModifiedDate:2026-07-24T23:50:02-04:00\nsize:{len(content)}\nzipSize:1\ngzSize:{size}\nsha256:{hashlib.sha256(content).hexdigest()}\n"


def test_acquired_snapshots(spark, tmp_path):
    root, out = str(tmp_path / "root"), str(tmp_path / "out")
    path, meta = snapshot_files(tmp_path)
    assert dictionary.acquire_snapshot(root, path, meta, dry_run=True) == {"snapshot_id": "20260725T035002Z", "action": "acquire"}
    with pytest.raises(EngineError, match="gzSize"):
        dictionary.acquire_snapshot(root, path, meta.replace("gzSize:", "gzSize:1"))
    assert dictionary.acquire_snapshot(root, path, meta)["action"] == "acquired"
    assert [p.name for p in (tmp_path / "root").iterdir()] == ["20260725T035002Z"]
    assert dictionary.acquire_snapshot(root, path, meta)["action"] == "verified"
    for bad in (99, 20_001, "100"):
        with pytest.raises(EngineError):
            dictionary.import_acquired(spark, root, "20260725T035002Z", out, bad)
    with pytest.raises(EngineError):
        dictionary.verify_snapshot(root, "2026")
    assert dictionary.import_acquired(spark, root, "20260725T035002Z", out, dry_run=True)["total"] == 2 and not list((tmp_path / "out").glob("*"))
    assert dictionary.import_acquired(spark, root, "20260725T035002Z", out) == {"total": 2, "active": 1, "deprecated": 1, "already_imported": False}
    assert dictionary.import_acquired(spark, root, "20260725T035002Z", out)["already_imported"]
    other, _ = snapshot_files(tmp_path, (4, 5))
    with pytest.raises(EngineError, match="against"):
        dictionary.import_snapshot(spark, other, "20260725T035002Z", out)
    manifest = tmp_path / "root" / "20260725T035002Z" / "manifest.json"
    manifest.write_text(manifest.read_text().replace('"VERIFIED"', '"PENDING"'))
    with pytest.raises(EngineError):
        dictionary.verify_snapshot(root, "20260725T035002Z")


def test_whole_set_import(spark):
    docs = frame(spark, json.dumps(document()), json.dumps(document(version=5))).withColumn("manifest_digest", F.concat(F.lit("d"), F.substring("source_path", 2, 1)))
    records = spark.createDataFrame([("d0", "r", "1", "p", "r@d0"), ("d1", "r", "2", "p", "r@d1")], "manifest_digest string, repository string, tag string, platform string, pinned_reference string")
    images = records.filter("manifest_digest = 'd0'")
    sboms = spark.createDataFrame([], "file_sha256 string, source_path string, spec_version string, generator_name string, generator_version string, manifest_digest string")
    got = sbom.import_documents(docs, records, images, sboms)
    assert got["totals"].first().asDict() == {"files": 2, "created": 2, "skipped": 0, "components_created": 6, "with_cpe": 2}
    assert [r["manifest_digest"] for r in got["images"].collect()] == ["d1"] and got["components"].count() == 6
    again = sbom.import_documents(docs, records, records, got["sboms"], dry_run=True)
    assert set(again) == {"files", "totals"} and again["totals"].first()["skipped"] == 2
    with pytest.raises(EngineError, match="document metadata"):
        sbom.import_documents(docs, records, images, got["sboms"].withColumn("spec_version", F.lit("0")))
    with pytest.raises(EngineError, match="image metadata"):
        sbom.import_documents(docs, records, images.withColumn("tag", F.lit("9")), sboms)
    with pytest.raises(EngineError, match="image without document"):
        sbom.import_documents(docs.filter("manifest_digest = 'd0'"), records, images, sboms)
