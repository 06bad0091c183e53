"""Exports, normalisation, workflows: small archives made in code."""

from __future__ import annotations

import json
import zipfile
from datetime import UTC, datetime
from pathlib import Path

import duckdb
import pytest

from threadloom import catalogue, cli
from threadloom import schema as S
from threadloom.plans import workflows
from threadloom.sources import archive_json, normalize, render, zip_export
from threadloom.streaming import incremental


def message(text, role="user", **more):
    return {"id": f"m-{text[:8]}", "author": {"role": role}, "create_time": 1700000000.5, "content": {"content_type": "text", "parts": [text]}, **more}


def chain(identity, texts, title="A talk", **more):
    mapping = {"root": {"id": "root", "parent": None, "children": ["n0"], "message": None}}
    for i, t in enumerate(texts):
        mapping[f"n{i}"] = {"id": f"n{i}", "parent": f"n{i - 1}" if i else "root", "children": [f"n{i + 1}"] if i + 1 < len(texts) else [], "message": message(t, ["user", "assistant"][i % 2])}
    return {"id": identity, "title": title, "create_time": 1700000000, "update_time": "2024-05-01T10:00:00Z", "current_node": f"n{len(texts) - 1}", "mapping": mapping, **more}


def export(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content if isinstance(content, bytes | str) else json.dumps(content))
    return str(path)


def codes(frames):
    return sorted(r["code"] for r in frames["warning"].collect())


def payload(spark, value, path="conversations.json"):
    data = value if isinstance(value, bytes) else json.dumps(value).encode()
    return spark.createDataFrame([(0, path, bytearray(data))], "part long, path string, content binary")


def test_paths_and_kinds(spark):
    rows = ["a/b.json", "../x", "/x", "a\\b", "C:/x", "", "a/../b", "ok", "x\u0000y", "a..b/c"]
    got = spark.createDataFrame([(r,) for r in rows], "p string").select("p", zip_export.safe_path(__import__("pyspark").sql.functions.col("p")).alias("ok")).collect()
    assert [r["p"] for r in got if r["ok"]] == ["a/b.json", "ok", "a..b/c"]
    kinds = {"conversations.json": "conversations_json", "x/Conversations.json": "conversations_json_candidate", "conversations-1.json": "conversations_json_candidate", "a.json": "json", "b.txt": "other"}
    frame = spark.createDataFrame([(k,) for k in kinds], "p string")
    assert {r["p"]: r["k"] for r in frame.select("p", zip_export.detected_kind(frame.p).alias("k")).collect()} == kinds


def test_preflight(spark, tmp_path):
    path = export(tmp_path / "a.zip", {"conversations.json": [], "Dir/a.txt": "x", "dir/A.txt": "y", "../evil": "z", "big.txt": "0" * 2_000_000})
    found = zip_export.manifest(spark, path, S.Limits(max_compression_ratio=50))
    assert sorted(w["code"] for w in found["warnings"]) == ["duplicate_member_path", "duplicate_member_path", "suspicious_compression_ratio", "unsafe_zip_path"]
    assert [f["path"] for f in found["files"]] == ["big.txt", "conversations.json"]
    with pytest.raises(S.UnsafeArchive):
        workflows.ingest(spark, path, S.Limits(max_compression_ratio=50))
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr(link, "target")
    assert [w["code"] for w in zip_export.manifest(spark, str(tmp_path / "b.zip"))["warnings"]] == ["symlink_member"]
    (tmp_path / "c.zip").write_text("no zip")
    with pytest.raises(S.InvalidArchive):
        zip_export.manifest(spark, str(tmp_path / "c.zip"))
    with pytest.raises(S.LimitExceeded):
        zip_export.read_member(path, "big.txt", 2_000_000, 1000)
    hashed = zip_export.manifest(spark, export(tmp_path / "d.zip", {"conversations.json": "[]"}), hash_members=True)
    assert hashed["files"][0]["sha256"] == __import__("hashlib").sha256(b"[]").hexdigest()


def member(path, kind=None, readable=True):
    return {"path": path, "detected_kind": kind or "conversations_json_candidate", "is_readable": readable}


def test_payload_selection():
    select = zip_export.select_payload
    assert select([member("conversations.json", "conversations_json"), member("x/conversations.json")])[0][0]["path"] == "conversations.json"
    assert select([member("x/conversations.json")])[1][0]["code"] == "noncanonical_conversations_path"
    assert select([member("conversations-old.json")])[1][0]["code"] == "noncanonical_conversations_filename"
    parts = [member(f"conversations-{i:03d}.json") for i in (2, 0, 10, 1)]
    with pytest.raises(S.AmbiguousPayload):
        select(parts)
    assert [m["path"][-8:-5] for m in select([p for p in parts if "010" not in p["path"]])[0]] == ["000", "001", "002"]
    for bad in ([member("x/conversations.json"), member("y/conversations.json")], [member("conversations-0.json"), member("x/conversations-1.json")], [member("conversations-1.json"), member("conversations-01.json")]):
        with pytest.raises(S.AmbiguousPayload):
            select(bad)
    with pytest.raises(S.PayloadNotFound):
        select([member("a.json", "json"), member("conversations.json", "conversations_json", False)])


def test_strict_decoding():
    assert normalize.decode(b"\xef\xbb\xbf[1]") == ([1], True)
    assert normalize.decode(b'{"a": 1, "a": 2}') == ({"a": 2}, False)
    for bad in (b"[NaN]", b"[Infinity]", b"[1", b"\xff", b"[" * 100_000):
        with pytest.raises(S.InvalidPayload):
            normalize.decode(bad)
    assert normalize.roots({"conversations": [], "items": [1]})[0] == []
    assert normalize.roots({"items": [1]})[1][0][0] == "wrapped_payload_root"
    assert normalize.roots({"mapping": {}})[1][0][0] == "single_conversation_payload"
    for bad in ({"conversations": None}, {"x": 1}, 3, "x"):
        with pytest.raises(S.UnsupportedSchema):
            normalize.roots(bad)


@pytest.mark.parametrize("value, moment, code", [
    (None, None, None), (True, None, "invalid_timestamp"), (0, datetime(1970, 1, 1, tzinfo=UTC), None), (1.5, datetime(1970, 1, 1, 0, 0, 1, 500000, tzinfo=UTC), None),
    ("2024-01-01T00:00:00Z", datetime(2024, 1, 1, tzinfo=UTC), None), ("2024-01-01T02:00:00+02:00", datetime(2024, 1, 1, tzinfo=UTC), None), ("2024-01-01", datetime(2024, 1, 1, tzinfo=UTC), "naive_timestamp"),
    ("nonsense", None, "invalid_timestamp"), (1e30, None, "invalid_timestamp"), ([], None, "invalid_timestamp"),
])
def test_timestamps(value, moment, code):
    assert normalize.instant(value) == (moment, code)


def test_normalisation_of_a_clean_talk(spark):
    talk = chain("c1", ["hello", "world", "again"])
    talk["mapping"]["alt"] = {"id": "alt", "parent": "n0", "children": [], "message": message("other", "assistant")}
    frames = normalize.normalize(payload(spark, [talk]))
    assert codes(frames) == ["source_child_edges_disagree"]
    assert json.loads(frames["warning"].first()["context"]) == {"nodes_with_differences": 1, "missing_source_edges": 1, "conflicting_source_edges": 0, "dangling_source_edges": 0, "duplicate_source_edges": 0}
    path = frames["node"].where("is_on_current_path").orderBy("path_pos").collect()
    assert [r["node_id"] for r in path] == ["root", "n0", "n1", "n2"]
    assert {r["node_id"]: r["children_node_ids"] for r in frames["node"].collect()}["n0"] == ["alt", "n1"]
    first = frames["message"].where("node_id = 'n0'").first()
    assert (first["role"], first["created_at"]) == ("user", datetime(2023, 11, 14, 22, 13, 20, 500000))
    assert frames["block"].where("node_id = 'alt'").first()["text"] == "other"


def test_every_kind_of_trouble(spark):
    odd = {
        "id": 7, "title": 3, "create_time": True, "update_time": "2024-01-01", "current_node": "b", "extra": 1,
        "mapping": {
            "a": {"id": "z", "parent": 5, "children": [1, "b"], "message": "x"},
            "b": {"parent": "gone", "children": 3, "message": {"author": "me", "metadata": 4, "end_turn": "yes", "content": 5, "id": 9}},
            "c": 4,
            "d": {"parent": "e", "children": ["d", "d", "a", "ghost"], "message": {"author": {"role": "Robot"}, "content": {"content_type": "text", "parts": 1}}},
            "e": {"parent": "d", "message": {"author": {"role": "USER"}, "content": {"content_type": "new"}}},
        },
    }
    cycle = {"id": "x", "current_node": "p", "mapping": {"p": {"parent": "q"}, "q": {"parent": "p"}}}
    frames = normalize.normalize(payload(spark, [odd, "no record", {"id": "x"}, cycle, {"mapping": {}, "current_node": "q"}]))
    want = {
        "dangling_parent", "duplicate_conversation_id", "graph_cycle", "invalid_author", "invalid_child_id", "invalid_children", "invalid_content", "invalid_content_parts", "invalid_conversation_record",
        "invalid_end_turn", "invalid_mapping_node", "invalid_message", "invalid_message_metadata", "invalid_parent_id", "invalid_timestamp", "missing_current_node", "missing_mapping", "naive_timestamp",
        "node_id_mismatch", "orphan_component", "source_child_edges_disagree", "unknown_author_role", "unknown_content_type", "unknown_current_node",
    }
    assert set(codes(frames)) == want
    talks = frames["conversation"].orderBy("source_index").collect()
    assert [(t["source_index"], t["conversation_id"], t["record_index"]) for t in talks] == [(0, None, 0), (1, "x", 2), (2, "x", 3), (3, None, 4)]
    assert json.loads(talks[0]["source_extras"]) == {"extra": 1}
    nodes = {r["node_id"]: r for r in frames["node"].where("source_index = 0").collect()}
    assert json.loads(nodes["a"]["source_extras"]) == {"embedded_id": "z", "raw_children": [1, "b"], "raw_message": "x", "raw_parent": 5}
    assert nodes["e"]["source_children_node_ids"] is None and nodes["a"]["source_children_node_ids"] == ["b"]
    assert frames["node"].where("source_index = 2 and is_on_current_path").isEmpty()
    few = normalize.normalize(payload(spark, [odd]), S.Limits(max_warnings=4))
    assert few["warning"].count() == 5 and "warnings_suppressed" in codes(few)
    with pytest.raises(S.StrictModeViolation):
        normalize.normalize(payload(spark, [odd]), strict=True)
    with pytest.raises(S.LimitExceeded):
        normalize.normalize(payload(spark, [odd, odd]), S.Limits(max_conversations=1))
    assert codes(normalize.normalize(payload(spark, b"\xef\xbb\xbf[]"))) == ["utf8_bom"]


def test_a_table_of_malformed_records_keeps_every_warning(spark, tmp_path):
    """More warnings than an archive's budget: the query over a table has none, an archive still has."""
    spark.range(12_100).selectExpr("id as conv_id", "0L as turn", "'hello' as text", "'user' as role").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["malformed_record_warnings"](spark, str(tmp_path)).select("conversation_id", "code").collect()), key=repr)
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = engine.execute(f"SELECT conversation_id, code FROM ({catalogue.SQL['malformed_record_warnings']})").fetchall()
    assert len(want) > S.Limits().max_warnings and got == sorted(want, key=repr)


def test_relations_are_whole_and_an_archive_is_bounded(spark):
    talks = payload(spark, [{"mapping": {}} for _ in range(3)])
    few = S.Limits(max_warnings=2)
    assert codes(normalize.relations(normalize.decoded(talks, few))) == ["missing_current_node"] * 3
    assert codes(normalize.normalize(talks, few)) == ["missing_current_node"] * 2 + ["warnings_suppressed"]
    small = S.Limits(max_conversations=2)
    assert normalize.relations(normalize.decoded(talks, small))["conversation"].count() == 3
    with pytest.raises(S.LimitExceeded):
        normalize.normalize(talks, small)


def test_blocks():
    record = normalize.Record({"mapping": {}, "current_node": None}, "p", 0, S.Limits())
    kinds = lambda content: [(b["type"], b["text"], b["reference"]) for b in record.blocks("n", content, "")]
    assert kinds({"content_type": "code", "text": "x=1", "language": "py"}) == [("code", "x=1", None)]
    assert kinds({"content_type": "execution_output", "text": "1"}) == [("tool_result", "1", None)]
    assert kinds({"content_type": "tool_result", "result": "2"}) == [("tool_result", "2", None)]
    assert kinds({"content_type": "thoughts", "thoughts": [{"summary": "a", "content": "b"}], "text": "c"}) == [("thinking_trace", "a\n\nb\n\nc", None)]
    assert kinds({"content_type": "reasoning_recap"}) == [("reasoning_summary", None, None)]
    parts = [{"asset_pointer": "f://1", "content_type": "image_asset_pointer"}, {"url": "f://2", "mime_type": "audio/x"}, {"url": "f://3"}, {"x": 1}, 5, "t"]
    assert [k[::2] for k in kinds({"content_type": "multimodal_text", "parts": parts})] == [("image_reference", "f://1"), ("audio_reference", "f://2"), ("file_reference", "f://3"), ("unknown", None), ("unknown", None), ("markdown", None)]


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    topics = ["We decided to keep alpha-tool. The alpha-tool goal is a python model.", "The piano music of bach. It remains to check the midi score.", "My therapist and my medication."]
    talks = [chain(f"c{i}", [topics[i % 3], f"Answer {i} about {topics[i % 3]}"], f"Talk {i % 3}") | {"create_time": 1700000000 + i * 86400 * 40} for i in range(18)]
    half = len(talks) // 2
    return export(tmp_path_factory.mktemp("zip") / "export.zip", {"conversations-0.json": talks[:half], "conversations-1.json": talks[half:], "chat.html": "x"})


def test_whole_run(spark, archive, tmp_path):
    out = tmp_path / "run"
    summary = workflows.run(spark, archive, out, publish_safe=True)
    assert summary["safety"] == {"include": 12, "exclude": 6, "review": 0}
    assert workflows.verify(spark, out) == []
    for p in out.rglob("*"):
        if p.is_file() and p.suffix in (".html", ".json", ".md"):
            assert "therapist" not in p.read_text()
    whole = archive_json.read_archive(spark, out / "archive.json")
    assert whole["conversation"].count() == 12 and whole["node"].count() == 36
    assert spark.read.parquet(str(out / "atlas/catalog.parquet")).count() == 12
    assert "Talk 0" in (out / "atlas/book.html").read_text()
    first = next(out.glob("volumes/volume-*.html"))
    first.write_text(first.read_text() + " ")
    (out / "volumes/index.html").unlink()
    (out / "new.txt").write_text("x")
    assert workflows.verify(spark, out) == sorted([(first.relative_to(out).as_posix(), "size"), ("volumes/index.html", "missing"), ("new.txt", "unlisted")])
    with pytest.raises(ValueError):
        workflows.run(spark, archive, out)
    workflows.bundle(out, tmp_path / "run.zip")
    assert "workflow.json" in zipfile.ZipFile(tmp_path / "run.zip").namelist()


def test_canonical_json_is_stable(spark, archive, tmp_path):
    for name in ("a", "b"):
        frames = workflows.ingest(spark, archive)
        archive_json.write_archive(frames, frames["manifest"], tmp_path / name)
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    (tmp_path / "c").write_text(json.dumps(json.loads((tmp_path / "a").read_text()) | {"more": 1}))
    with pytest.raises(S.UnsupportedSchema):
        archive_json.read_archive(spark, tmp_path / "c")


def test_redaction_in_volumes(spark, archive, tmp_path):
    frames = workflows.ingest(spark, archive)
    volumes = workflows.compile_volumes(frames, tmp_path / "v", workflows.VolumeOptions(mode="complete", redactions=((r"piano\s+music", "[gone]"),)))
    text = (tmp_path / "v/volume-complete.html").read_text()
    assert "piano music" not in text and "[gone]" in text
    assert volumes[0]["conversation_count"] == 18 and volumes[0]["message_count"] == 36
    with pytest.raises(ValueError):
        render.compile_rules([("(", "")])


def test_cli(spark, archive, tmp_path, capsys):
    assert cli.main(["--master", "local[2]", "inspect", archive]) == 0
    assert json.loads(capsys.readouterr().out)["files"][0]["path"] == "chat.html"
    assert cli.main(["inspect", str(tmp_path / "none.zip")]) == 2
    assert cli.main(["ingest", archive, str(tmp_path / "a.json")]) == 0 and (tmp_path / "a.json").exists()


def test_safe_markdown():
    text = render.markdown("# T\n<script>x</script>\n\n- a\n- **b**\n\n1. c\n\n> q\n\n```\n<b>\n```\n[x](javascript:y) [z](https://e.org) ![alt](http://i) `<`")
    assert "<script>" not in text and "javascript" not in text and '<a href="https://e.org"' in text and "<img" not in text
    assert "<h3>T</h3>" in text and "<li><strong>b</strong></li>" in text and "<pre><code>&lt;b&gt;</code></pre>" in text


def test_incremental(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")]
    spark.createDataFrame(rows[:1] + rows[2:], incremental.TURNS).coalesce(1).write.parquet(source)
    for extra in (None, rows):
        if extra:
            spark.createDataFrame(extra, incremental.TURNS).coalesce(1).write.mode("append").parquet(source)
        incremental.keep_latest(incremental.turns(spark, source), out, str(tmp_path / "state")).awaitTermination()
    got = {r["conv_id"]: r["text"] for r in incremental.latest(spark, out).collect()}
    assert got == {1: "User:\na\n\nAssistant:\nb", 2: "User:\nc"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert {"histogram", "value", "n"} == set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert Path(entry.__file__).exists()
