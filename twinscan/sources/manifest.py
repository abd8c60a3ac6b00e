"""File manifests: listing of project folders, archives, and the steps from raw files to usable ones.

A plain binary scan hides names that start with `_` or `.`, so `__init__.py` would be lost; folders are
walked inside tasks instead, one project root per input row.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.functions.languages import detect_language, is_supported
from twinscan.functions.text import decode_text
from twinscan.schema import MANIFEST

COLUMNS = [f.name for f in MANIFEST.fields]


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for sid, root in zip(batch["submission_id"], batch["root"]):
            if not os.path.isdir(root):
                yield _frame([(sid, root, False, 0, None, "notADirectory")])
                continue
            for folder, dirs, files in os.walk(root):
                below = os.path.relpath(folder, root)
                base = "" if below == "." else below + "/"
                rows = [(sid, base + d, True, 0, None, None) for d in sorted(dirs)]
                for name in sorted(files):
                    full = os.path.join(folder, name)
                    try:
                        with open(full, "rb") as f:
                            data = f.read()
                        rows.append((sid, base + name, False, len(data), data, None))
                    except OSError as e:
                        rows.append((sid, base + name, False, 0, None, type(e).__name__))
                if rows:
                    yield _frame(rows)


def read_file_manifest(roots: DataFrame) -> DataFrame:
    """Every file and directory under each root (submission_id, root); roots on storage all executors see."""
    return roots.select("submission_id", "root").mapInPandas(_walk, MANIFEST)


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"]):
            name = path.rsplit("/", 1)[-1]
            sid = name.rsplit(".", 1)[0] if "." in name[1:] else name
            if not zipfile.is_zipfile(io.BytesIO(data)):
                yield _frame([(sid, name, False, len(data), data, None)])
                continue
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for entry in z.infolist():
                        body = None if entry.is_dir() else z.read(entry)
                        size = 0 if body is None else len(body)
                        yield _frame([(sid, entry.filename.rstrip("/"), entry.is_dir(), size, body, None)])
            except (zipfile.BadZipFile, zipfile.LargeZipFile, RuntimeError, OSError, EOFError, ValueError) as e:
                yield _frame([(sid, name, False, len(data), None, f"badArchive: {type(e).__name__}")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of each archive object; anything that is no zip is taken as a single file."""
    return expand_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def expand_archives(archives: DataFrame) -> DataFrame:
    return archives.select("path", "content").mapInPandas(_unzip, MANIFEST)


def resolve_project_root(manifest: DataFrame) -> DataFrame:
    """Strip the top folder of submissions whose only visible top-level entry is that folder.

    The aggregate keeps a least and a greatest name per submission, not the set of names.
    """
    top = F.element_at(F.split("path", "/"), 1)
    visible = ~top.startswith(".")
    is_folder = F.col("is_dir") | F.col("path").contains("/")
    tops = manifest.groupBy("submission_id").agg(
        F.min(F.when(visible, top)).alias("_least"),
        F.max(F.when(visible, top)).alias("_most"),
        F.max(F.when(visible, is_folder)).alias("_folder"),
    )
    root = F.when((F.col("_least") == F.col("_most")) & F.col("_folder"), F.col("_least"))
    inside = manifest.join(tops.select("submission_id", root.alias("_root")), "submission_id")
    prefix = F.concat("_root", F.lit("/"))
    return (
        inside.filter(F.col("_root").isNull() | F.col("path").startswith(prefix))
        .withColumn(
            "path",
            F.when(F.col("_root").isNotNull(), F.col("path").substr(F.length(prefix) + 1, F.length("path"))).otherwise(F.col("path")),
        )
        .drop("_root")
    )


def supported_files(manifest: DataFrame) -> DataFrame:
    """Files with a known suffix. The suffix table is a constant of the plan, so this stays a filter."""
    return manifest.filter(~F.col("is_dir") & is_supported(F.col("path")))


def source_files(manifest: DataFrame) -> DataFrame:
    """Decoded supported files with their language and a stable id."""
    return supported_files(manifest).filter(F.col("content").isNotNull()).select(
        F.sha2(F.concat_ws("\u0001", "submission_id", "path"), 256).alias("file_id"),
        "submission_id",
        "path",
        detect_language(F.col("path")).alias("language"),
        decode_text(F.col("content")).alias("content"),
    )
