"""Tables that grow by parts, each of which counts once however often it is written.

A part is written to a folder of its own and then committed by one empty marker file that
names the part and the folder.  Readers see committed folders only, and one for each part:
a writer that died before its marker left nothing, and a repeated append of a committed part
does nothing.  If two writers race with the same part, both may commit; readers then take the
folder whose name is least, so the part still counts once.

The listing of the markers, one per append, is the only thing that the driver holds.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.=-]*")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _markers(spark: SparkSession, path: str) -> list[str]:
    fs, p = _folder(spark, f"{path}/commits")
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def committed_parts(spark: SparkSession, path: str) -> dict[str, str]:
    """{part: folder} of every committed part."""
    out: dict[str, str] = {}
    for marker in _markers(spark, path):
        if "@" in marker and not marker.startswith("."):
            part, _, attempt = marker.partition("@")
            out.setdefault(part, f"{path}/parts/{part}@{attempt}")
    return out


def write_attempt(rows: DataFrame, path: str, part: str) -> str:
    """Write the rows of a part without committing them; returns the attempt's name."""
    if not _NAME.fullmatch(part):
        raise ValueError(f"a part's name has letters, digits, '.', '=' and '-' only, not {part!r}")
    attempt = uuid.uuid4().hex[:16]
    rows.write.parquet(f"{path}/parts/{part}@{attempt}")
    return attempt


def commit(spark: SparkSession, path: str, part: str, attempt: str) -> None:
    """Make a written attempt visible: one empty file, so it is there or it is not."""
    fs, marker = _folder(spark, f"{path}/commits/{part}@{attempt}")
    fs.create(marker, False).close()


def append_part(rows: DataFrame, path: str, part: str) -> bool:
    """Write and commit a part; False, with nothing written, if it is committed already."""
    spark = rows.sparkSession
    if part in committed_parts(spark, path):
        return False
    commit(spark, path, part, write_attempt(rows, path, part))
    return True


def read_parts(spark: SparkSession, path: str, schema, only: list[str] | None = None) -> DataFrame:
    """The rows of every committed part (or of those named in `only`), once each; no part gives no rows."""
    parts = committed_parts(spark, path)
    folders = [folder for part, folder in sorted(parts.items()) if only is None or part in only]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)
