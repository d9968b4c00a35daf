"""Dictionary snapshots: metadata, archive validation, manifest, record parsing, and publication."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tarfile
import tempfile
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlens.errors import EngineError
from bomlens.functions.cpe import FIELDS, VALID, parse
from bomlens.functions.text import canonical_uuid, utc_timestamp
from bomlens.operators.checks import duplicates, require_empty

#: Fixed values of the snapshot format.
META_KEYS = ("lastModifiedDate", "size", "zipSize", "gzSize", "sha256")
MEMBER_FOLDERS = ("", "nvdcpe-2.0-chunks")
MEMBER = re.compile(r"nvdcpe-2\.0-chunk-(\d{5})\.json")
BLOCK = 1 << 20
SNAPSHOT_ID, SHA256_TEXT = re.compile(r"\d{8}T\d{6}Z"), re.compile("[0-9a-f]{64}")
MANIFEST_FILE, ARCHIVE_FILE, META_FILE = "manifest.json", "nvdcpe-2.0.tar.gz", "nvdcpe-2.0.meta"
#: The least and the greatest number of rows in a batch.
BATCH_SIZES = (100, 20_000)


def parse_metadata(text: str) -> dict:
    """The five values of a metadata text of key:value lines."""
    found: dict[str, str] = {}
    for line in filter(None, (x.strip() for x in text.splitlines())):
        key, colon, value = (x.strip() for x in line.partition(":"))
        if not colon or not value or key in found:
            raise EngineError("invalid_metadata", f"bad line: {line}")
        found[key] = value
    if missing := [k for k in META_KEYS if k not in found]:
        raise EngineError("invalid_metadata", f"missing: {', '.join(missing)}")
    moment = datetime.fromisoformat(found["lastModifiedDate"])
    if moment.tzinfo is None or not re.fullmatch("[0-9a-fA-F]{64}", found["sha256"]) or not all(found[k].isdigit() for k in META_KEYS[1:4]):
        raise EngineError("invalid_metadata", "bad value")
    return {"last_modified": moment.astimezone(UTC), **{k: int(found[k]) for k in META_KEYS[1:4]}, "sha256": found["sha256"].lower()}


def file_sha256(path: str) -> str:
    """Digest of a file, read a block at a time."""
    digest = hashlib.sha256()
    with open(path, "rb") as source:
        while block := source.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def safe_member(name: str) -> bool:
    """Whether a member's path is relative, not empty, and never leaves its folder."""
    parts = PurePosixPath(name).parts
    return bool(parts) and not name.startswith("/") and ".." not in parts


def archive_members(path: str) -> list[dict]:
    """(sequence, name, size, sha256) in numeric order, of an archive that keeps all rules; the rest raises."""
    found = {}
    with tarfile.open(path, "r:*") as archive:
        for member in archive:
            if not safe_member(member.name):
                raise EngineError("invalid_archive", f"unsafe path: {member.name}")
            if member.isdir():
                if member.name.rstrip("/") not in MEMBER_FOLDERS:
                    raise EngineError("invalid_archive", f"unknown folder: {member.name}")
                continue
            folder, _, name = member.name.rpartition("/")
            match = MEMBER.fullmatch(name)
            if not member.isreg() or folder not in MEMBER_FOLDERS or not match:
                raise EngineError("invalid_archive", f"unexpected member: {member.name}")
            sequence = int(match[1])
            if sequence in found:
                raise EngineError("invalid_archive", f"sequence {sequence} stands twice")
            digest, source = hashlib.sha256(), archive.extractfile(member)
            while block := source.read(BLOCK):
                digest.update(block)
            found[sequence] = {"sequence": sequence, "name": member.name, "size": member.size, "sha256": digest.hexdigest()}
    if not found or sorted(found) != list(range(1, len(found) + 1)):
        raise EngineError("invalid_archive", "members do not count from 1 without gaps")
    return [found[n] for n in sorted(found)]


def aggregate(path: str, members: list[dict]) -> dict:
    """Size and digest of all members' bytes in numeric order, nothing between them."""
    digest, size = hashlib.sha256(), 0
    with tarfile.open(path, "r:*") as archive:
        for member in members:
            source = archive.extractfile(member["name"])
            while block := source.read(BLOCK):
                digest.update(block)
                size += len(block)
    return {"size": size, "sha256": digest.hexdigest()}


def build_manifest(path: str, snapshot_id: str, metadata: dict) -> dict:
    """Provenance of a validated archive; size and digest of the content must be those of the metadata."""
    members = archive_members(path)
    whole = aggregate(path, members)
    if whole["sha256"] != metadata["sha256"] or whole["size"] != metadata["size"]:
        raise EngineError("invalid_archive", "content differs from the metadata")
    return {
        "schema_version": 2, "snapshot_id": snapshot_id, "status": "VERIFIED",
        "archive": {"filename": os.path.basename(path), "size": os.path.getsize(path), "sha256": file_sha256(path)},
        "content": {"format": "json", "member_count": len(members), "ordering": "numeric", "separator": "", "aggregate_size": whole["size"], "aggregate_sha256": whole["sha256"], "members": members},
    }


def verify_manifest(manifest: dict, path: str) -> None:
    """Raise unless the manifest describes the archive at path."""
    if manifest.get("schema_version") != 2 or manifest.get("status") != "VERIFIED":
        raise EngineError("invalid_manifest")
    if manifest["archive"]["sha256"] != file_sha256(path) or manifest["content"]["members"] != archive_members(path):
        raise EngineError("invalid_manifest", "archive differs from its manifest")


def write_new(path: str, value: dict) -> None:
    """A JSON file that must not be there yet."""
    with open(path, "x", encoding="utf-8") as sink:
        json.dump(value, sink, indent=2, sort_keys=True)
        sink.write("\n")


def verify_snapshot(root: str, snapshot_id: str) -> dict:
    """The manifest of an acquired snapshot below root, after its id, schema, member list and bytes were checked."""
    if not SNAPSHOT_ID.fullmatch(snapshot_id):
        raise EngineError("invalid_snapshot_id", snapshot_id)
    folder = os.path.join(root, snapshot_id)
    for name in (MANIFEST_FILE, ARCHIVE_FILE, META_FILE):
        if not os.path.isfile(os.path.join(folder, name)):
            raise EngineError("snapshot_incomplete", name)
    with open(os.path.join(folder, MANIFEST_FILE), encoding="utf-8") as source:
        manifest = json.load(source)
    if not isinstance(manifest, dict) or manifest.get("snapshot_id") != snapshot_id or not isinstance(manifest.get("archive"), dict) or not isinstance(manifest.get("content"), dict):
        raise EngineError("invalid_manifest", "snapshot_id, archive or content")
    members = manifest["content"].get("members")
    if manifest["archive"].get("filename") != ARCHIVE_FILE or not isinstance(members, list) or manifest["content"].get("member_count") != len(members) or [m.get("sequence") for m in members] != list(range(1, len(members) + 1)):
        raise EngineError("invalid_manifest", "archive or members")
    if any(not SHA256_TEXT.fullmatch(str(x)) for x in (manifest["archive"].get("sha256"), manifest["content"].get("aggregate_sha256"))):
        raise EngineError("invalid_manifest", "sha256")
    verify_manifest(manifest, os.path.join(folder, ARCHIVE_FILE))
    with open(os.path.join(folder, META_FILE), encoding="utf-8") as source:
        metadata = parse_metadata(source.read())
    if (manifest["content"]["aggregate_sha256"], manifest["content"]["aggregate_size"], manifest["archive"]["size"]) != (metadata["sha256"], metadata["size"], metadata["gzSize"]):
        raise EngineError("invalid_manifest", "content differs from the metadata")
    return manifest


def acquire_snapshot(root: str, archive: str, metadata_text: str, dry_run: bool = False) -> dict:
    """Take a fetched archive and its metadata into root as one folder, or verify the one that is there.

    The folder appears whole, by a rename, after everything was checked. A dry run only tells what would be done.
    """
    metadata = parse_metadata(metadata_text)
    snapshot_id = metadata["last_modified"].strftime("%Y%m%dT%H%M%SZ")
    folder = os.path.join(root, snapshot_id)
    there = os.path.isdir(folder)
    if dry_run:
        return {"snapshot_id": snapshot_id, "action": "verify" if there else "acquire"}
    if there:
        if verify_snapshot(root, snapshot_id)["content"]["aggregate_sha256"] != metadata["sha256"]:
            raise EngineError("snapshot_differs", snapshot_id)
        return {"snapshot_id": snapshot_id, "action": "verified"}
    if os.path.getsize(archive) != metadata["gzSize"]:
        raise EngineError("invalid_archive", f"gzSize is {metadata['gzSize']}, the archive has {os.path.getsize(archive)} bytes")
    os.makedirs(root, exist_ok=True)
    staging = tempfile.mkdtemp(dir=root, prefix=".staging-")
    try:
        shutil.copyfile(archive, os.path.join(staging, ARCHIVE_FILE))
        write_new(os.path.join(staging, MANIFEST_FILE), build_manifest(os.path.join(staging, ARCHIVE_FILE), snapshot_id, metadata))
        with open(os.path.join(staging, META_FILE), "x", encoding="utf-8") as sink:
            sink.write(metadata_text)
        os.rename(staging, folder)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return {"snapshot_id": snapshot_id, "action": "acquired"}


def archive_chunks(spark: SparkSession, path: str, members: list[dict]) -> DataFrame:
    """(sequence, content) of the members. A compressed archive is read from its start, so one task reads it, once, member by member."""
    sequences = {m["name"]: m["sequence"] for m in members}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with tarfile.open(name, "r:*") as archive:
                    for member in archive:
                        if member.name in sequences:
                            yield pa.RecordBatch.from_pydict({"sequence": [sequences[member.name]], "content": [archive.extractfile(member).read().decode()]}, schema=pa.schema([("sequence", pa.int32()), ("content", pa.string())]))

    return spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(run, "sequence int, content string")


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """(sequence, rule) of chunks whose envelope is wrong."""
    doc = F.try_parse_json("content")
    rows = chunks.select("sequence", doc.alias("doc"), F.size(F.try_variant_get(doc, "$.products", "array<variant>")).alias("held"))
    of = {k: F.try_variant_get("doc", f"$.{k}", "int") for k in ("resultsPerPage", "startIndex", "totalResults")}
    totals = rows.agg(F.min(of["totalResults"]).alias("low"), F.max(of["totalResults"]).alias("high"))
    joined = rows.join(F.broadcast(totals))
    rules = F.array_compact(
        F.array(
            F.when(F.col("doc").isNull() | F.col("held").isNull() | of["resultsPerPage"].isNull() | of["startIndex"].isNull() | of["totalResults"].isNull(), "envelope"),
            F.when(of["resultsPerPage"] != F.col("held"), "resultsPerPage"),
            F.when(of["startIndex"] != F.col("sequence"), "startIndex"),
            F.when(F.col("low") != F.col("high"), "totalResults"),
        )
    )
    return joined.select("sequence", F.explode(rules).alias("rule"))


def products(chunks: DataFrame) -> DataFrame:
    """(sequence, product): one variant per product."""
    return chunks.select("sequence", F.explode(F.try_variant_get(F.try_parse_json("content"), "$.products", "array<variant>")).alias("product"))


def _list(product: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(product, f"$.cpe.{key}", "array<variant>"), F.array().cast("array<variant>"))


def records(rows: DataFrame) -> DataFrame:
    """Dictionary rows of products, with the eleven attributes and `errors` (key names) for those that break a rule."""
    product = F.col("product")

    def text(key: str) -> Column:
        return F.try_variant_get(product, f"$.cpe.{key}", "string")

    flag = F.schema_of_variant(F.try_variant_get(product, "$.cpe.deprecated", "variant"))
    out = rows.select(
        "sequence",
        canonical_uuid(text("cpeNameId")).alias("cpe_name_id"),
        text("cpeName").alias("cpe_name"),
        F.when(flag == "BOOLEAN", F.try_variant_get(product, "$.cpe.deprecated", "boolean")).alias("deprecated"),
        utc_timestamp(text("created")).alias("created_at_nvd"),
        utc_timestamp(text("lastModified")).alias("last_modified_at_nvd"),
        _list(product, "titles").alias("titles"),
        _list(product, "refs").alias("references"),
        _list(product, "deprecatedBy").alias("deprecated_by"),
        _list(product, "deprecates").alias("deprecates"),
    )
    parsed = parse(out, "cpe_name")
    errors = F.array_compact(
        F.array(
            F.when(F.col("cpe_name_id").isNull(), "cpeNameId"), F.when(F.col("status") != VALID, "cpeName"), F.when(F.col("deprecated").isNull(), "deprecated"),
            F.when(F.col("created_at_nvd").isNull(), "created"), F.when(F.col("last_modified_at_nvd").isNull(), "lastModified"),
        )
    )
    return parsed.withColumn("errors", errors).drop("fields", "status")


def feed_totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"), F.count_if(~F.col("deprecated")).alias("active"), F.count_if("deprecated").alias("deprecated"))


def import_snapshot(spark: SparkSession, archive: str, snapshot_id: str, target: str, batch_size: int = 5_000, dry_run: bool = False) -> dict:
    """Parse, check and publish a snapshot as Parquet with at most batch_size rows a file.

    A snapshot that is there must come from the same bytes and hold the rows that it tells; it is never rewritten. A dry run
    checks everything and publishes nothing.
    """
    if type(batch_size) is not int or not BATCH_SIZES[0] <= batch_size <= BATCH_SIZES[1]:
        raise EngineError("invalid_batch_size", f"{batch_size!r} is not between {BATCH_SIZES[0]} and {BATCH_SIZES[1]}")
    members = archive_members(archive)
    hashes = {"archive_sha256": file_sha256(archive), "content_sha256": aggregate(archive, members)["sha256"], "members": len(members)}
    jvm = spark.sparkContext._jvm
    final, about = f"{target}/snapshot_id={snapshot_id}", f"{target}/snapshot_id={snapshot_id}/_snapshot.json"
    path = jvm.org.apache.hadoop.fs.Path
    store = path(final).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(path(final)) and not dry_run:
        if not store.exists(path(about)):
            raise EngineError("snapshot_differs", "it does not say what it was made from")
        stream = store.open(path(about))
        known = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        totals = feed_totals(spark.read.parquet(final)).first().asDict()
        if known != hashes | totals:
            raise EngineError("snapshot_differs", f"{known} against {hashes | totals}")
        return totals | {"already_imported": True}
    staging, unpacked = f"{target}/_staging-{snapshot_id}", f"{target}/_chunks-{snapshot_id}"
    try:
        archive_chunks(spark, archive, members).write.mode("overwrite").option("maxRecordsPerFile", 1).parquet(unpacked)
        chunks = spark.read.parquet(unpacked)
        found = records(products(chunks))
        bad = found.filter(F.size("errors") > 0).select("cpe_name", "errors")
        require_empty({"chunk": chunk_violations(chunks), "record": bad, "repeated uuid": duplicates(found, "cpe_name_id"), "repeated name": duplicates(found, "cpe_name")})
        totals = feed_totals(found).first().asDict()
        if dry_run:
            return totals | {"already_imported": False}
        kept = found.select("cpe_name_id", "cpe_name", "deprecated", "created_at_nvd", "last_modified_at_nvd", *FIELDS, *[F.to_json(F.col(c)).alias(c) for c in ("titles", "references", "deprecated_by", "deprecates")])
        kept.write.mode("overwrite").option("maxRecordsPerFile", batch_size).parquet(staging)
        sink = store.create(path(f"{staging}/_snapshot.json"))
        sink.writeBytes(json.dumps(hashes | totals))
        sink.close()
        if not store.rename(path(staging), path(final)):
            raise EngineError("publish_failed")
    finally:
        for folder in (staging, unpacked):
            store.delete(path(folder), True)
    return totals | {"already_imported": False}


def import_acquired(spark: SparkSession, root: str, snapshot_id: str, target: str, batch_size: int = 5_000, dry_run: bool = False) -> dict:
    """import_snapshot of an acquired snapshot below root, after verify_snapshot."""
    verify_snapshot(root, snapshot_id)
    return import_snapshot(spark, os.path.join(root, snapshot_id, ARCHIVE_FILE), snapshot_id, target, batch_size, dry_run)


def representative_title(titles: Column) -> Column:
    """The first title in English, else the first that is not empty, else ''; other shapes are passed over."""
    plain = F.transform(titles, lambda t: F.struct(F.try_variant_get(t, "$.title", "string").alias("title"), F.schema_of_variant(F.try_variant_get(t, "$.title", "variant")).alias("kind"), F.try_variant_get(t, "$.lang", "string").alias("lang")))
    texts = F.filter(plain, lambda t: F.coalesce(t["kind"] == "STRING", F.lit(False)))
    english = F.get(F.filter(texts, lambda t: F.startswith(F.lower(F.coalesce(t["lang"], F.lit(""))), F.lit("en"))), F.lit(0))
    other = F.get(F.filter(texts, lambda t: t["title"] != ""), F.lit(0))
    return F.coalesce(english["title"], other["title"], F.lit(""))


def normal_references(references: Column) -> Column:
    """array<struct(url, type)>: url where that key is there, else ref, else ''; anything but an object is dropped."""
    objects = F.filter(references, lambda r: F.startswith(F.schema_of_variant(r), F.lit("OBJECT")))

    def text(r: Column, key: str) -> Column:
        value = F.try_variant_get(r, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(r, f"$.{key}", "string")).otherwise("")

    return F.transform(objects, lambda r: F.struct(F.when(F.try_variant_get(r, "$.url", "variant").isNotNull(), text(r, "url")).otherwise(text(r, "ref")).alias("url"), text(r, "type").alias("type")))
