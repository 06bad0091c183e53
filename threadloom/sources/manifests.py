"""Artifact manifests: digests of everything a run wrote, and their verification."""

from __future__ import annotations

import platform
import sys
import zipfile
from pathlib import Path, PurePosixPath

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def artifacts(spark: SparkSession, folder: str | Path) -> DataFrame:
    """path (relative), size_bytes, sha256 of every file below a folder."""
    base = Path(folder).resolve().as_posix()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    return files.select(F.substring(path, len(base) + 2, 1 << 20).alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def provenance(spark: SparkSession, **extra) -> dict:
    return {"python": sys.version.split()[0], "system": platform.system(), "machine": platform.machine(), "spark": spark.version, "pyspark": pyspark.__version__, **extra}


def verify(spark: SparkSession, folder: str | Path, manifest: list[dict]) -> DataFrame:
    """path, problem (missing, size, digest, unlisted, unsafe) for whatever isn't as the manifest says."""
    unsafe = [(m["path"], "unsafe") for m in manifest if PurePosixPath(m["path"]).is_absolute() or ".." in PurePosixPath(m["path"]).parts]
    bad = {p for p, _ in unsafe}
    rows = [(m["path"], m["size_bytes"], m["sha256"]) for m in manifest if m["path"] not in bad]
    listed = spark.createDataFrame(rows, "path string, size long, digest string")
    found = artifacts(spark, folder) if any(p.is_file() for p in Path(folder).rglob("*")) else spark.createDataFrame([], "path string, size_bytes long, sha256 string")
    both = listed.join(found, "path", "full")
    problem = F.when(F.col("size_bytes").isNull(), "missing").when(F.col("size").isNull(), "unlisted").when(F.col("size") != F.col("size_bytes"), "size").when(F.col("digest") != F.col("sha256"), "digest")
    return both.select("path", problem.alias("problem")).where("problem is not null").unionByName(spark.createDataFrame(unsafe, "path string, problem string"))


def bundle(folder: str | Path, target: str | Path) -> None:
    """A ZIP of a folder, sorted, with fixed times: equal folders give equal bundles."""
    base = Path(folder)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(x for x in base.rglob("*") if x.is_file() and not x.name.startswith(".")):
            info = zipfile.ZipInfo(p.relative_to(base).as_posix(), (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, p.read_bytes())
    with zipfile.ZipFile(target) as z:
        if z.testzip() is not None:
            raise OSError("the bundle is damaged")


def same_run(planned: dict, found: dict, fields: list[str], budget: str = "ceiling") -> list[str]:
    """Fields in which a resumed run differs from the one on disk; a budget may grow."""
    return [f for f in fields if planned.get(f) != found.get(f) and not (f == budget and planned.get(f, 0) >= found.get(f, 0))]
