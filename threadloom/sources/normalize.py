"""Decoded export records to the archive's flat relations, with a warning for everything that isn't as expected.

Each record is normalised on its own, so the work is a narrow map; types are probed, never cast: a number where a string
belongs becomes null, a warning, and is kept among the extras.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom import schema as S
from threadloom.functions import vocabulary as V
from threadloom.plans.session import settled

_REASONING_KEYS = ("parts", "thoughts", "summary", "recap", "text", "content")
_DEEPEST = 8


def decode(data: bytes) -> tuple[object, bool]:
    """Strict JSON in UTF-8, with or without a byte order mark; no NaN, no infinity."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        return json.loads(data.decode("utf-8-sig"), parse_constant=refuse), data.startswith(b"\xef\xbb\xbf")
    except (ValueError, RecursionError) as e:
        raise S.InvalidPayload("a conversation member is not strict JSON in UTF-8") from e


def roots(payload: object) -> tuple[list, list[tuple[str, str, dict]]]:
    """A payload's records, and warnings (code, location, context). The presence of a key decides, not its value."""
    if isinstance(payload, list):
        return payload, []
    if not isinstance(payload, dict):
        raise S.UnsupportedSchema("the JSON root is neither a list nor a known object")
    for key in ("conversations", "items"):
        if key in payload:
            if not isinstance(payload[key], list):
                raise S.UnsupportedSchema(f"the field {key} is not a list")
            return payload[key], [("wrapped_payload_root", f"/{key}", {"wrapper_key": key})]
    if "mapping" in payload:
        return [payload], [("single_conversation_payload", "/", {})]
    raise S.UnsupportedSchema("the JSON root has no conversation field")


def jsonable(value):
    """Source data as JSON: numbers that aren't finite become null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, list):
        return [jsonable(x) for x in value]
    if isinstance(value, dict):
        return {k: jsonable(v) for k, v in value.items()}
    return value


def _text(value) -> str | None:
    return None if value is None else json.dumps(jsonable(value), ensure_ascii=False, sort_keys=True)


def _pointer(part: str) -> str:
    return part.replace("~", "~0").replace("/", "~1")


def instant(value) -> tuple[datetime | None, str | None]:
    """(UTC, warning code): epoch numbers and ISO text; text without a zone is UTC; booleans are no numbers."""
    if value is None:
        return None, None
    try:
        if isinstance(value, str):
            moment = datetime.fromisoformat(value.replace("Z", "+00:00"))
            return (moment.astimezone(UTC), None) if moment.tzinfo else (moment.replace(tzinfo=UTC), "naive_timestamp")
        if isinstance(value, int | float) and not isinstance(value, bool):
            return datetime.fromtimestamp(value, UTC), None
    except (ValueError, OverflowError, OSError):
        pass
    return None, "invalid_timestamp"


def reasoning(value, depth: int = 0) -> list[str]:
    """Text fragments of a reasoning payload, in a fixed order of keys, not deeper than eight levels."""
    if depth > _DEEPEST:
        return []
    if isinstance(value, str):
        return [value]
    inner = value if isinstance(value, list) else [value[k] for k in _REASONING_KEYS if k in value] if isinstance(value, dict) else []
    return [x for v in inner for x in reasoning(v, depth + 1)]


class Record:
    """One conversation record: rows for each relation and its warnings."""

    def __init__(self, raw: dict, path: str, index: int, limits: S.Limits):
        self.raw, self.path, self.at, self.limits = raw, path, f"/{index}", limits
        self.conversation_id = raw["id"] if isinstance(raw.get("id"), str) else None
        self.warnings: list[dict] = []
        self.nodes: dict[str, dict] = {}
        mapping = raw.get("mapping")
        if not isinstance(mapping, dict):
            self.warn("missing_mapping", "/mapping")
            mapping = {}
        if len(mapping) > limits.max_nodes_per_conversation:
            raise S.LimitExceeded("a conversation has too many nodes")
        for node_id in sorted(mapping):
            self.nodes[node_id] = self.node(node_id, mapping[node_id])
        self.edges()
        self.orphans()
        self.current, self.path_ids = self.current_path()
        self.created, self.updated = (self.time(raw.get(k), f"/{k}") for k in ("create_time", "update_time"))
        position = {n: i for i, n in enumerate(self.path_ids)}
        for n, node in self.nodes.items():
            node["path_pos"] = position.get(n)

    def warn(self, code: str, where: str, node_id: str | None = None, **context) -> None:
        self.warnings.append({"severity": "warning", "code": code, "source_path": self.path, "conversation_id": self.conversation_id, "node_id": node_id, "location": self.at + where, "context": _text(context) if context else None})

    def time(self, value, where: str, node_id: str | None = None) -> datetime | None:
        moment, code = instant(value)
        if code:
            self.warn(code, where, node_id, **({"source_type": type(value).__name__} if code == "invalid_timestamp" else {}))
        return moment

    def node(self, node_id: str, raw) -> dict:
        where = f"/mapping/{_pointer(node_id)}"
        node = {"node_id": node_id, "parent": None, "children": [], "declared": None, "message": None, "extras": {}}
        if not isinstance(raw, dict):
            self.warn("invalid_mapping_node", where, node_id)
            return node | {"extras": {"raw_node": raw}}
        extras = {k: v for k, v in raw.items() if k not in ("id", "parent", "children", "message")}
        if isinstance(raw.get("id"), str) and raw["id"] != node_id:
            extras["embedded_id"] = raw["id"]
            self.warn("node_id_mismatch", f"{where}/id", node_id)
        for key, kind, code, bad in (("parent", str, "invalid_parent_id", "raw_parent"), ("children", list, "invalid_children", "raw_children"), ("message", dict, "invalid_message", "raw_message")):
            if raw.get(key) is not None and not isinstance(raw[key], kind):
                extras[bad] = raw[key]
                self.warn(code, f"{where}/{key}", node_id)
        if isinstance(raw.get("parent"), str):
            node["parent"] = raw["parent"]
        if isinstance(raw.get("children"), list):
            node["declared"] = [c for c in raw["children"] if isinstance(c, str)]
            if len(node["declared"]) < len(raw["children"]):
                extras["raw_children"] = raw["children"]
                self.warn("invalid_child_id", f"{where}/children", node_id)
        if isinstance(raw.get("message"), dict):
            node["message"] = self.message(node_id, raw["message"], f"{where}/message")
        return node | {"extras": extras}

    def message(self, node_id: str, raw: dict, where: str) -> dict:
        known = ("id", "author", "create_time", "update_time", "content", "metadata", "recipient", "status", "end_turn")
        extras = {k: v for k, v in raw.items() if k not in known}
        parts = {}
        for key, code in (("author", "invalid_author"), ("metadata", "invalid_message_metadata")):
            value = raw.get(key)
            parts[key] = value if isinstance(value, dict) else {}
            if value is not None and not isinstance(value, dict):
                extras[f"raw_{key}"] = value
                self.warn(code, f"{where}/{key}", node_id)
        end = raw.get("end_turn")
        if end is not None and not isinstance(end, bool):
            self.warn("invalid_end_turn", f"{where}/end_turn", node_id)
        role = parts["author"].get("role")
        folded = role.casefold() if isinstance(role, str) else None
        if folded not in V.ROLES:
            extras["raw_author_role"] = role
            self.warn("unknown_author_role", f"{where}/author/role", node_id)
            folded = "unknown"
        string = lambda v: v if isinstance(v, str) else None
        model = parts["metadata"].get("model_slug", parts["metadata"].get("default_model_slug"))
        return {
            "message_id": string(raw.get("id")),
            "role": folded,
            "author_name": string(parts["author"].get("name")),
            "created_at": self.time(raw.get("create_time"), f"{where}/create_time", node_id),
            "updated_at": self.time(raw.get("update_time"), f"{where}/update_time", node_id),
            "content": [{"block_pos": i} | b for i, b in enumerate(self.blocks(node_id, raw.get("content"), f"{where}/content"))],
            "model": string(model),
            "recipient": string(raw.get("recipient")),
            "status": string(raw.get("status")),
            "end_turn": end if isinstance(end, bool) else None,
            "metadata": _text(parts["metadata"]),
            "source_extras": _text(extras),
        }

    def blocks(self, node_id: str, content, where: str) -> list[dict]:
        def block(kind: str, text=None, source=None, language=None, reference=None, metadata=None) -> dict:
            return {"type": kind, "text": text, "language": language, "reference": reference, "source_content_type": source, "metadata": _text(metadata)}

        if content is None:
            return []
        if not isinstance(content, dict):
            self.warn("invalid_content", where, node_id, source_type=type(content).__name__)
            return [block("unknown", metadata={"raw_content": content})]
        kind = content["content_type"] if isinstance(content.get("content_type"), str) else None
        if kind in ("text", "multimodal_text"):
            if not isinstance(content.get("parts"), list):
                self.warn("invalid_content_parts", f"{where}/parts", node_id, source_type=type(content.get("parts")).__name__)
                return [block("unknown", source=kind, metadata={"raw_content": content})]
            return [block("markdown", p, kind) if isinstance(p, str) else self.part(p, kind, block) for p in content["parts"]]
        if kind == "code" and isinstance(content.get("text"), str):
            language = content.get("language")
            return [block("code", content["text"], kind, language if isinstance(language, str) else None)]
        if kind in ("execution_output", "tool_result"):
            result = content["text"] if "text" in content else content.get("result")
            if isinstance(result, str):
                return [block("tool_result", result, kind)]
        if kind in ("thoughts", "reasoning_recap"):
            found = reasoning(content)
            return [block("thinking_trace" if kind == "thoughts" else "reasoning_summary", "\n\n".join(found) if found else None, kind, metadata={"raw_content": content})]
        self.warn("unknown_content_type", where, node_id, content_type=kind)
        return [block("unknown", source=kind, metadata={"raw_content": content})]

    @staticmethod
    def part(part, kind: str, block) -> dict:
        if not isinstance(part, dict):
            return block("unknown", source=kind, metadata={"raw_part": part})
        string = lambda k: part[k] if isinstance(part.get(k), str) else None
        pointer = string("asset_pointer") if string("asset_pointer") is not None else string("url")
        told = f"{string('mime_type') or ''} {string('content_type') or ''}".casefold()
        media = "unknown" if pointer is None else "image_reference" if "image" in told else "audio_reference" if "audio" in told else "file_reference"
        return block(media, source=kind, reference=pointer, metadata={"raw_part": part})

    def edges(self) -> None:
        """Children by parent pointers, and one warning that sums up how the declared ones differ."""
        for n, node in self.nodes.items():
            if node["parent"] in self.nodes:
                self.nodes[node["parent"]]["children"].append(n)
            elif node["parent"] is not None:
                self.warn("dangling_parent", f"/mapping/{_pointer(n)}/parent", n)
        sums = dict.fromkeys(("nodes_with_differences", "missing_source_edges", "conflicting_source_edges", "dangling_source_edges", "duplicate_source_edges"), 0)
        for node in self.nodes.values():
            if node["declared"] is None:
                continue
            said, real = set(node["declared"]), set(node["children"])
            differences = {
                "missing_source_edges": len(real - said),
                "conflicting_source_edges": sum(c in self.nodes for c in said - real),
                "dangling_source_edges": sum(c not in self.nodes for c in said - real),
                "duplicate_source_edges": len(node["declared"]) - len(said),
            }
            if any(differences.values()):
                sums["nodes_with_differences"] += 1
                for k, v in differences.items():
                    sums[k] += v
        if sums["nodes_with_differences"]:
            self.warn("source_child_edges_disagree", "/mapping", **sums)

    def orphans(self) -> None:
        todo = [n for n, node in self.nodes.items() if node["parent"] is None]
        seen = set(todo)
        while todo:
            fresh = [c for c in self.nodes[todo.pop()]["children"] if c not in seen]
            seen.update(fresh)
            todo += fresh
        lost = sorted(set(self.nodes) - seen)
        if lost:
            self.warn("orphan_component", "/mapping", count=len(lost), sample_node_ids=lost[:20])

    def current_path(self) -> tuple[str | None, list[str]]:
        """The declared node's ancestors from the root. Nothing is guessed: a cycle empties the path, a gap ends it."""
        declared = self.raw.get("current_node")
        if declared is None:
            self.warn("missing_current_node", "/current_node")
            return None, []
        if not isinstance(declared, str) or declared not in self.nodes:
            self.warn("unknown_current_node", "/current_node", source_type=type(declared).__name__)
            return declared if isinstance(declared, str) else None, []
        path: dict[str, None] = {}
        at: str | None = declared
        while at is not None:
            if at in path:
                self.warn("graph_cycle", "/current_node", at)
                return declared, []
            if at not in self.nodes:
                self.warn("dangling_parent", "/current_node", at)
                break
            path[at] = None
            at = self.nodes[at]["parent"]
        return declared, list(path)[::-1]

    def row(self) -> dict:
        title = self.raw.get("title")
        extras = {k: v for k, v in self.raw.items() if k not in ("id", "title", "create_time", "update_time", "current_node", "mapping")}
        return {
            "conversation_id": self.conversation_id,
            "title": title if isinstance(title, str) else None,
            "created_at": self.created,
            "updated_at": self.updated,
            "current_node_id": self.current,
            "source_extras": _text(extras),
            "nodes": [
                {"node_id": n["node_id"], "parent_node_id": n["parent"], "children_node_ids": sorted(n["children"]), "source_children_node_ids": n["declared"], "is_on_current_path": n["path_pos"] is not None, "path_pos": n["path_pos"], "source_extras": _text(n["extras"]), "message": n["message"]}
                for n in self.nodes.values()
            ],
            "warnings": sorted(self.warnings, key=lambda w: (w["code"], w["location"] or "", w["node_id"] or "")),
        }


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in _columns(ddl)) + ">"


def _columns(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


_NODES = f"array<{_struct(S.NODE.replace('source_index long, ', '') + ', message ' + _struct(S.MESSAGE))}>"
_RECORD = f"part long, source_path string, record_index long, conversation_id string, title string, created_at timestamp, updated_at timestamp, current_node_id string, source_extras string, nodes {_NODES}, warnings array<{_struct(S.WARNING)}>, problem string, had_bom boolean"


def _records(limits: S.Limits):
    def run(frames):
        import pandas as pd

        for frame in frames:
            for part, path, content in frame.itertuples(index=False):
                payload, bom = decode(bytes(content))
                found, notes = roots(payload)
                told = [{"severity": "warning", "code": code, "source_path": path, "conversation_id": None, "node_id": None, "location": where, "context": _text(context) if context else None} for code, where, context in notes]
                rows = [{"record_index": -1, "warnings": told, "problem": "payload"}]
                for i, raw in enumerate(found):
                    if isinstance(raw, dict):
                        rows.append(Record(raw, path, i, limits).row() | {"record_index": i})
                    else:
                        rows.append({"record_index": i, "warnings": [{"severity": "warning", "code": "invalid_conversation_record", "source_path": path, "conversation_id": None, "node_id": None, "location": f"/{i}", "context": _text({"source_type": type(raw).__name__})}], "problem": "record"})
                names = [c.split(" ", 1)[0] for c in _columns(_RECORD)]
                for start in range(0, len(rows), 200):
                    chunk = rows[start : start + 200]
                    yield pd.DataFrame([{n: r.get(n) for n in names} | {"part": part, "source_path": path, "had_bom": bom} for r in chunk], columns=names)

    return run


def decoded(payloads: DataFrame, limits: S.Limits = S.Limits()) -> DataFrame:
    """A row for each record of the payloads (part, path, content), with its nodes and warnings, and one for each payload."""
    return settled(payloads.select("part", "path", "content").mapInPandas(_records(limits), _RECORD))


def relations(rows: DataFrame) -> dict[str, DataFrame]:
    """conversation, node, message, block and warning from decoded rows, all of them: an archive's bounds are `normalize`'s.

    source_index is the position among all conversations, in order of part and record. Warnings keep part, record_index
    and seq, which order them.
    """
    talks = rows.where("problem is null")
    # A part's records are numbered already; the parts before it shift them: a few rows, one per part.
    counts = talks.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("record_index")) - 1
    slim = talks.select("part", "record_index").withColumn("_place", place).join(ahead, "part").select("part", "record_index", (F.col("ahead") + F.col("_place")).alias("source_index"))
    talks = settled(talks.join(slim, ["part", "record_index"]))
    conversation = talks.select(*(c.split(" ", 1)[0] for c in _columns(S.CONVERSATION)))
    nodes = talks.select("source_index", F.explode("nodes").alias("n")).select("source_index", "n.*")
    node = nodes.drop("message")
    message = nodes.where("message is not null").select("source_index", "node_id", "is_on_current_path", "path_pos", "message.*")
    block = message.select("source_index", "node_id", "role", "is_on_current_path", "path_pos", F.explode("content").alias("b")).select("source_index", "node_id", "role", "is_on_current_path", "path_pos", "b.*")
    told = rows.select("part", "record_index", F.posexplode("warnings").alias("seq", "w")).select("part", "record_index", "seq", "w.*")
    repeated = F.row_number().over(Window.partitionBy("conversation_id").orderBy("source_index")) > 1
    twins = talks.where("conversation_id is not null").withColumn("_again", repeated).where("_again")
    twins = twins.select("part", "record_index", F.lit(1 << 30).alias("seq"), F.lit("warning").alias("severity"), F.lit("duplicate_conversation_id").alias("code"), "source_path", "conversation_id", F.lit(None).cast("string").alias("node_id"), F.concat(F.lit("/"), F.col("record_index").cast("string"), F.lit("/id")).alias("location"), F.lit(None).cast("string").alias("context"))
    return {"conversation": conversation, "node": node, "message": message.drop("content"), "block": block, "warning": told.unionByName(twins)}


def normalize(payloads: DataFrame, limits: S.Limits = S.Limits(), strict: bool = False) -> dict[str, DataFrame]:
    """The relations of one archive, within its limits.

    Warnings beyond max_warnings, in the order of the records, are counted by one `warnings_suppressed` row.
    """
    rows = decoded(payloads, limits)
    totals = rows.where("record_index >= 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("nodes")), F.lit(0)).alias("nodes")).first()
    if totals["n"] > limits.max_conversations or totals["nodes"] > limits.max_total_nodes:
        raise S.LimitExceeded("the payloads exceed the limits of conversations or nodes")
    frames = relations(rows)
    warning = settled(frames["warning"])
    extra = warning.count() - limits.max_warnings
    order = ["part", "record_index", "seq"]
    if extra > 0:
        last = payloads.agg(F.max_by("path", "part").alias("p")).first()["p"]
        note = payloads.sparkSession.createDataFrame([("warning", "warnings_suppressed", last, None, None, "/", json.dumps({"suppressed_count": extra}))], S.WARNING)
        warning = warning.orderBy(*order).limit(limits.max_warnings).drop(*order).unionByName(note)
    else:
        warning = warning.drop(*order)
    marked = rows.where("had_bom").select("part").distinct().count()
    if marked:
        warning = warning.unionByName(payloads.sparkSession.createDataFrame([("info", "utf8_bom", None, None, None, None, json.dumps({"member_count": marked}))], S.WARNING))
    if strict and not warning.isEmpty():
        raise S.StrictModeViolation("strict mode allows no warnings")
    return frames | {"warning": warning}
