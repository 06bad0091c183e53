"""ZIP exports as a source: a metadata-only preflight, then bounded reads of the members that were chosen."""

from __future__ import annotations

import hashlib
import os
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from threadloom import schema as S

_NAMES = [c.split()[0] for c in S.MEMBER.split(", ")]


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _MemberReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self):
        return [_Archive(p) for p in self.paths]

    def read(self, partition):
        rows = []
        with zipfile.ZipFile(partition.path) as archive:
            for i in archive.infolist():
                rows.append((partition.path, i.filename, i.file_size, i.compress_size, i.CRC, i.compress_type, i.flag_bits, (i.external_attr >> 16) & 0xFFFF, i.is_dir()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))], _NAMES)


class ZipMembers(DataSource):
    """spark.read.format("zipmembers").load("a.zip,b.zip"): one row per entry of the central directories; no member is opened."""

    @classmethod
    def name(cls):
        return "zipmembers"

    def schema(self):
        return S.MEMBER

    def reader(self, schema):
        return _MemberReader(self.options)


def members(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(ZipMembers)
    try:
        for p in paths:
            if not os.path.isfile(p) or not zipfile.is_zipfile(p):
                raise S.InvalidArchive("the path is not a readable ZIP file")
        return spark.read.format("zipmembers").load(",".join(paths))
    except OSError as e:
        raise S.InvalidArchive("the path is not a readable ZIP file") from e


def safe_path(path: Column) -> Column:
    """Relative, with forward slashes, without NUL, drive letter or a part that climbs up."""
    parts = F.split(path, "/")
    return (path != "") & ~F.contains(path, F.lit("\u0000")) & ~F.contains(path, F.lit("\\")) & ~F.startswith(path, F.lit("/")) & ~F.array_contains(parts, "..") & ~path.rlike(r"^[A-Za-z]:") & ~path.rlike(r"^\.?/*$")


def detected_kind(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    candidate = (name == "conversations.json") | (F.startswith(name, F.lit("conversations")) & F.endswith(name, F.lit(".json")))
    return F.when(path == "conversations.json", "conversations_json").when(candidate, "conversations_json_candidate").when(F.endswith(name, F.lit(".json")), "json").otherwise("other")


def compression_ratio(size: Column, compressed: Column) -> Column:
    return F.when(size == 0, F.lit(0.0)).when(compressed == 0, F.lit(float("inf"))).otherwise(size / compressed)


def findings(rows: DataFrame, limits: S.Limits = S.Limits()) -> DataFrame:
    """Members with `codes`: every reason not to read them. Directories are left out."""
    twin = F.count(F.lit(1)).over(Window.partitionBy("archive", F.lower("path"))) > 1
    ratio = compression_ratio(F.col("size_bytes"), F.col("compressed_size_bytes"))
    checks = [
        ("unsafe_zip_path", ~safe_path(F.col("path"))),
        ("duplicate_member_path", twin),
        ("encrypted_member", F.col("flag_bits").bitwiseAND(1) == 1),
        ("symlink_member", F.col("unix_mode").bitwiseAND(0o170000) == 0o120000),
        ("member_too_large", F.col("size_bytes") > limits.max_member_uncompressed_bytes),
        ("suspicious_compression_ratio", (F.col("size_bytes") >= limits.min_ratio_check_bytes) & (ratio > limits.max_compression_ratio)),
    ]
    files = rows.where("not is_directory")
    codes = F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in checks)))
    return files.withColumn("detected_kind", detected_kind(F.col("path"))).withColumn("codes", codes)


def archive_findings(rows: DataFrame, limits: S.Limits = S.Limits()) -> DataFrame:
    """archive, files, total_uncompressed_bytes, total_compressed_bytes, codes (of the archive as a whole)."""
    totals = rows.groupBy("archive").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("total_uncompressed_bytes"), F.sum("compressed_size_bytes").alias("total_compressed_bytes"))
    codes = F.array_compact(F.array(F.when(F.col("files") > limits.max_files, "too_many_files"), F.when(F.col("total_uncompressed_bytes") > limits.max_total_uncompressed_bytes, "too_large_uncompressed")))
    return totals.withColumn("codes", codes)


def file_sha256(path: str, chunk: int = 1024**2) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(chunk):
            digest.update(data)
    return digest.hexdigest()


def read_member(archive: str, path: str, size: int, limit: int, chunk: int = 1024**2) -> bytes:
    """A member's bytes, never more than `limit`, and exactly as many as its directory entry says."""
    out, n = [], 0
    try:
        with zipfile.ZipFile(archive) as z, z.open(path) as f:
            while data := f.read(chunk):
                n += len(data)
                if n > limit:
                    raise S.LimitExceeded("a member exceeds its byte limit")
                out.append(data)
    except (zipfile.BadZipFile, KeyError, RuntimeError, OSError) as e:
        raise S.InvalidArchive("a member cannot be read") from e
    if n != size:
        raise S.InvalidArchive("a member's size differs from its directory entry")
    return b"".join(out)


def manifest(spark: SparkSession, path: str, limits: S.Limits = S.Limits(), hash_members: bool = False, hash_archive: bool = True) -> dict:
    """name, sizes, sha256, files (sorted by folded path), warnings. If any check fails, no member is opened."""
    rows = members(spark, [path])
    found = findings(rows, limits).orderBy(F.lower("path"), "path").collect()  # bounded by max_files below
    whole = archive_findings(rows, limits).first()
    warnings = [{"severity": "error", "code": c, "source_path": None} for c in (whole["codes"] if whole else [])]
    if os.path.getsize(path) > limits.max_archive_bytes:
        warnings.insert(0, {"severity": "error", "code": "archive_too_large", "source_path": None})
    warnings += [{"severity": "error", "code": c, "source_path": r["path"] if c != "unsafe_zip_path" else None} for r in found for c in r["codes"]]
    unlisted = {"unsafe_zip_path", "duplicate_member_path"}
    files = [
        {"path": r["path"], "size_bytes": r["size_bytes"], "compressed_size_bytes": r["compressed_size_bytes"], "crc32": r["crc32"], "compression_method": r["compression_method"], "sha256": None, "detected_kind": r["detected_kind"], "is_readable": not r["codes"]}
        for r in found
        if not unlisted & set(r["codes"])
    ]
    if hash_members and not warnings:
        for f in files:
            f["sha256"] = hashlib.sha256(read_member(path, f["path"], f["size_bytes"], limits.max_member_uncompressed_bytes, limits.read_chunk_bytes)).hexdigest()
    return {
        "archive_name": os.path.basename(path),
        "archive_size_bytes": os.path.getsize(path),
        "archive_sha256": file_sha256(path, limits.read_chunk_bytes) if hash_archive else None,
        "files": files,
        "total_uncompressed_bytes": whole["total_uncompressed_bytes"] if whole else 0,
        "total_compressed_bytes": whole["total_compressed_bytes"] if whole else 0,
        "warnings": warnings,
    }


def select_payload(files: list[dict]) -> tuple[list[dict], list[dict]]:
    """The members that hold the conversations, in order, and a warning if their names aren't the usual ones."""
    readable = [f for f in files if f["is_readable"]]
    base = lambda f: f["path"].rsplit("/", 1)[-1].casefold()
    warn = lambda code, f: [{"severity": "warning", "code": code, "source_path": f["path"]}]
    for chosen, code in (([f for f in readable if f["detected_kind"] == "conversations_json"], None), ([f for f in readable if base(f) == "conversations.json"], "noncanonical_conversations_path")):
        if len(chosen) > 1:
            raise S.AmbiguousPayload("several members are named conversations.json")
        if chosen:
            return chosen, warn(code, chosen[0]) if code else []
    candidates = [f for f in readable if f["detected_kind"] == "conversations_json_candidate"]
    if not candidates:
        raise S.PayloadNotFound("no member holds conversations")
    if len(candidates) == 1:
        return candidates, warn("noncanonical_conversations_filename", candidates[0])
    numbered = {}
    for f in candidates:
        m = re.fullmatch(r"conversations-(\d+)\.json", f["path"], re.I)
        if not m or int(m[1]) in numbered:
            raise S.AmbiguousPayload("the members aren't one numbered sequence at the root")
        numbered[int(m[1])] = f
    if sorted(numbered) != list(range(len(numbered))):
        raise S.AmbiguousPayload("the numbered members have gaps")
    return [numbered[i] for i in sorted(numbered)], []


def payloads(spark: SparkSession, path: str, files: list[dict], limits: S.Limits = S.Limits()) -> DataFrame:
    """part, path, content (binary), one row and one partition per member."""
    if any(f["size_bytes"] > limits.max_json_bytes for f in files) or sum(f["size_bytes"] for f in files) > limits.max_total_json_bytes:
        raise S.LimitExceeded("the conversation members exceed their byte limits")
    chunk, limit = limits.read_chunk_bytes, limits.max_json_bytes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, member, size in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([member]), pa.array([read_member(path, member, size, limit, chunk)], pa.binary())], ["part", "path", "content"])

    rows = spark.createDataFrame([(i, f["path"], f["size_bytes"]) for i, f in enumerate(files)], "part long, path string, size_bytes long")
    return rows.repartition(len(files), "part").mapInArrow(read, "part long, path string, content binary")
