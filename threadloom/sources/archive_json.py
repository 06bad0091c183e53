"""The archive as one canonical JSON document: sorted keys, indented, written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schema as S

VERSION = "1.0"


def atomic_write(path: str | Path, parts: Iterator[str] | str) -> None:
    """Writes beside the target, syncs, and renames."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            for part in [parts] if isinstance(parts, str) else parts:
                f.write(part)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, value) -> None:
    atomic_write(path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n")


def nested(frames: dict[str, DataFrame]) -> DataFrame:
    """source_index, json: one conversation with its nodes, messages and blocks."""
    blocks = frames["block"].groupBy("source_index", "node_id").agg(F.array_sort(F.collect_list(F.struct("block_pos", "type", "text", "language", "reference", "source_content_type", "metadata"))).alias("content"))
    messages = frames["message"].drop("is_on_current_path", "path_pos").join(blocks, ["source_index", "node_id"], "left")
    fields = [c for c in messages.columns if c not in ("source_index", "node_id")]
    messages = messages.select("source_index", "node_id", F.struct(*fields).alias("message"))
    nodes = frames["node"].join(messages, ["source_index", "node_id"], "left")
    columns = [c for c in nodes.columns if c != "source_index"]
    rows = nodes.groupBy("source_index").agg(F.array_sort(F.collect_list(F.struct(*columns[:1], F.to_json(F.struct(*columns)).alias("j")))).alias("nodes"))
    talks = frames["conversation"].join(rows, "source_index", "left")
    return talks.select("source_index", F.to_json(F.struct(*[c for c in talks.columns if c != "nodes"])).alias("head"), F.transform("nodes", lambda n: n["j"]).alias("nodes"))


def write_archive(frames: dict[str, DataFrame], manifest: dict, path: str | Path, metadata: dict | None = None) -> None:
    """Streams conversations in order to one file; the driver holds one partition at a time."""

    def indent(value, level: int) -> str:
        return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).replace("\n", "\n" + " " * level)

    def parts() -> Iterator[str]:
        yield '{\n  "archive_version": ' + json.dumps(VERSION) + ',\n  "conversations": ['
        for i, row in enumerate(nested(frames).orderBy("source_index").toLocalIterator()):
            talk = json.loads(row["head"]) | {"nodes": [json.loads(n) for n in row["nodes"] or ()]}
            yield (",\n    " if i else "\n    ") + indent(talk, 4)
        yield "\n  ],\n"
        warnings = [json.loads(r[0]) for r in frames["warning"].orderBy("code", "source_path", "location", "node_id").select(F.to_json(F.struct("*"))).toLocalIterator()]
        yield f'  "metadata": {indent(metadata or {}, 2)},\n  "source_manifest": {indent(manifest, 2)},\n  "warnings": {indent(warnings, 2)}\n}}\n'

    atomic_write(path, parts())


_FIELDS = {"archive_version", "conversations", "metadata", "source_manifest", "warnings"}


def read_archive(spark: SparkSession, path: str | Path) -> dict:
    """conversation and node relations and the plain rest. The schema is closed: unknown or missing fields are errors."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    if not isinstance(whole, dict) or set(whole) != _FIELDS or whole["archive_version"] != VERSION:
        raise S.UnsupportedSchema("not an archive of this version")
    talks, nodes = [], []
    for talk in whole["conversations"]:
        talks.append(json.dumps({k: v for k, v in talk.items() if k != "nodes"}))
        nodes += [json.dumps({"source_index": talk["source_index"]} | n) for n in talk["nodes"]]

    def table(rows: list[str], ddl: str) -> DataFrame:
        known = {c.strip().split()[0] for c in ddl.split(",") if " " in c.strip()} | {"message"}
        for r in rows[:1]:
            if not set(json.loads(r)) <= known:
                raise S.UnsupportedSchema("unknown fields")
        return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", ddl, {"mode": "FAILFAST"}).alias("r")).select("r.*")

    message = "struct<message_id:string,role:string,author_name:string,created_at:timestamp,updated_at:timestamp,model:string,recipient:string,status:string,end_turn:boolean,metadata:string,source_extras:string,content:array<struct<block_pos:int,type:string,text:string,language:string,reference:string,source_content_type:string,metadata:string>>>"
    return {"conversation": table(talks, S.CONVERSATION), "node": table(nodes, S.NODE + ", message " + message), "warnings": whole["warnings"], "manifest": whole["source_manifest"], "metadata": whole["metadata"]}
