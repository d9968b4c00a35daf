"""Report files: CSV with Python's quoting and JSON summaries, published together, and small-table updates."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlens.errors import EngineError
from bomlens.operators.checks import require_empty

#: Options under which Spark's CSV equals that of Python's csv module.
CSV_OPTIONS = {"header": "true", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def python_bool(column: Column) -> Column:
    return F.when(column.isNull(), "").when(column, "True").otherwise("False")


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A folder of CSV parts, written by the tasks; for results of any size."""
    flags = {name: python_bool(F.col(name)) for name, kind in df.dtypes if kind == "boolean"}
    df.withColumns(flags).write.mode("overwrite" if overwrite else "errorifexists").options(**CSV_OPTIONS).csv(path)


def render_csv(df: DataFrame) -> str:
    """A bounded report as one CSV text, in the order of df."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    for row in df.toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return out.getvalue()


def write_report(folder: str, texts: dict[str, str], overwrite: bool = False) -> list[str]:
    """Several files on the driver's disk, each by a temporary file and a rename; none is touched if any is there already."""
    os.makedirs(folder, exist_ok=True)
    paths = [os.path.join(folder, name) for name in texts]
    if not overwrite and (there := [p for p in paths if os.path.exists(p)]):
        raise EngineError("report_exists", ", ".join(there))
    staged = []
    try:
        for path, text in zip(paths, texts.values(), strict=True):
            handle, temporary = tempfile.mkstemp(dir=folder, prefix=".staged-")
            with os.fdopen(handle, "w", encoding="utf-8", newline="") as sink:
                sink.write(text)
                sink.flush()
                os.fsync(sink.fileno())
            staged.append((temporary, path))
        for temporary, path in staged:
            os.replace(temporary, path)
    finally:
        for temporary, _ in staged:
            if os.path.exists(temporary):
                os.unlink(temporary)
    return paths


def summary_json(row: dict) -> str:
    return json.dumps(row, indent=2, sort_keys=True, default=str) + "\n"


def report_folder(root: str, name: str, snapshot_id: str, given: str | None = None) -> str:
    """The given folder, relative ones below root, else one per report and snapshot."""
    if given:
        return given if os.path.isabs(given) else os.path.join(root, given)
    return os.path.join(root, "analysis", name, snapshot_id)


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of changes in place of those with the same keys; changes hold a key once."""
    require_empty({"repeated key": changes.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")})
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*table.columns))


def replaced_links(bridge: DataFrame, owner: str, changes: DataFrame) -> DataFrame:
    """A bridge table in which every owner that changes names has exactly the links of changes; a null link only clears."""
    value = [c for c in bridge.columns if c != owner][0]
    kept = bridge.join(changes.select(owner).distinct(), owner, "left_anti")
    return kept.unionByName(changes.filter(F.col(value).isNotNull()).select(*bridge.columns).distinct())
