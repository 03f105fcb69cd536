"""Files: strict lines, null cells, run directories as they lie on disk, manifests, staging."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from auditkit.operators.columns import CheckFailed
from auditkit.sources import files, staging


def test_csv_round_trip_with_empty_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1.5), (2, " ", None), (3, "x,\"y\"", 0.0)], "a int, s string, d double")
    files.write_csv(df, f"{tmp_path}/t")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/t", df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_strict_lines(spark, tmp_path):
    p = tmp_path / "ledger.jsonl"
    p.write_text('{"cost_usd": 1.5, "label": "a"}\n\n{"cost_usd": 2.0, "label": null}\n')
    got = files.read_lines_strict(spark, str(p), "cost_usd double, label string", ("cost_usd",))
    assert got.agg(F.sum("cost_usd")).head()[0] == 3.5 and got.count() == 2
    for bad in ('{"cost_usd": 1', '{"label": "no cost"}', '{"cost_usd": "abc"}'):
        p.write_text('{"cost_usd": 1.5}\n' + bad + "\n")
        with pytest.raises(CheckFailed, match="1 lines"):
            files.read_lines_strict(spark, str(p), "cost_usd double, label string", ("cost_usd",))


def test_export_has_null_for_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, None)], "a int, x double")
    assert [json.loads(r[0])["x"] for r in files.export_rows(df).collect()] == [None, 0.5, None]


def test_run_directories(spark, tmp_path):
    for name, canary in (("r1", True), ("r2", None)):
        d = tmp_path / name
        d.mkdir()
        manifest = {"config_id": f"tools-{name}", "mode": "REAL", "is_usable": True, "turns": 2, "usage": {"input": 5, "output": 6},
                    "limits": {"max_turns": 9}}
        if canary is not None:
            manifest["canary"] = canary
        (d / "manifest.json").write_text(json.dumps(manifest, indent=2))
        calls = [{"seq": i, "tool": "t", "arguments": {"n": i}, "ok": True, "outcome": "found"} for i in (1, 2)]
        (d / "tool_call_log.json").write_text(json.dumps({"calls": calls}, indent=1))
        messages = [{"role": "user", "content": "go"},
                    {"role": "assistant", "content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "u1", "name": "t", "input": {}}]},
                    {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u1", "content": "{\"v\": 1.5}"}]}]
        (d / "messages.json").write_text(json.dumps({"messages": messages}))
        (d / "final_answer.txt").write_text("line 1\nline 2")
    got = files.read_runs(spark, str(tmp_path))
    assert {r["run"]: (r["canary"], r["usage"]["input"], r["limits"]["max_turns"]) for r in got["runs"].collect()} == {
        "r1": (True, 5, 9), "r2": (None, 5, 9)}
    assert got["calls"].filter("run = 'r1'").orderBy("seq").select("arguments").collect()[1][0] == '{"n":2}'
    blocks = got["blocks"].filter("run = 'r2'").orderBy("turn", "pos").collect()
    assert [(b["turn"], b["type"], b["name"]) for b in blocks] == [(1, "text", None), (1, "tool_use", "t"), (2, "tool_result", None)]
    assert blocks[2]["content"] == '{"v": 1.5}' and got["messages"].count() == 6
    assert got["answers"].head()["text"] == "line 1\nline 2"


def test_hashes(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    rows = [tuple(r) for r in files.file_hashes(spark, str(tmp_path)).collect()]
    stored = spark.createDataFrame(rows, "file string, sha256 string")
    (tmp_path / "b").write_text("changed")
    (tmp_path / "c").unlink()
    (tmp_path / "d").write_text("new")
    got = {r["file"]: r["status"] for r in files.compare_hashes(files.file_hashes(spark, str(tmp_path)), stored).collect()}
    assert got == {"a": "ok", "b": "changed", "c": "missing", "d": "unlisted"}


def test_hashes_stream_in_pieces(spark, tmp_path, monkeypatch):
    """A file of many pieces, an empty one and an odd name; nothing of a file is held beyond a piece."""
    content = {"large": bytes(range(256)) * 50_000, "empty": b"", "an odd name %20": b"x"}
    for n, b in content.items():
        (tmp_path / n).write_bytes(b)
    want = {n: hashlib.sha256(b).hexdigest() for n, b in content.items()}
    assert {r["file"]: r["sha256"] for r in files.file_hashes(spark, str(tmp_path)).collect()} == want
    monkeypatch.setattr(files, "STREAMED", ())
    assert {r["file"]: r["sha256"] for r in files.file_hashes(spark, str(tmp_path)).collect()} == want
    assert files.file_hashes(spark, str(tmp_path), "la*").count() == 1


def test_hashes_of_tables_kept_as_folders(spark, tmp_path, monkeypatch):
    (tmp_path / "one.parquet").write_bytes(b"1")
    (tmp_path / "many.parquet").mkdir()
    (tmp_path / "many.parquet" / "part-0").write_bytes(b"2")
    (tmp_path / "many.parquet" / "part-1").write_bytes(b"")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.parquet").write_bytes(b"3")
    got = {r["file"]: r["sha256"] for r in files.file_hashes(spark, str(tmp_path), "*.parquet").collect()}
    assert set(got) == {"one.parquet", "many.parquet"} and got["one.parquet"] == hashlib.sha256(b"1").hexdigest()
    monkeypatch.setattr(files, "STREAMED", ())
    assert {r["file"]: r["sha256"] for r in files.file_hashes(spark, str(tmp_path), "*.parquet").collect()} == got
    monkeypatch.undo()
    (tmp_path / "many.parquet" / "part-1").write_bytes(b"x")
    again = {r["file"]: r["sha256"] for r in files.file_hashes(spark, str(tmp_path), "*.parquet").collect()}
    assert again["one.parquet"] == got["one.parquet"] and again["many.parquet"] != got["many.parquet"]


def test_upsert_replaces(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, files.upsert(base, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_stage_is_built_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    key = ("dir", "once")
    assert staging.stage(spark, key, build).count() == staging.stage(spark, key, build).count() == 5
    assert len(calls) == 1


def test_directories_are_written_whole_and_listed_by_few_tasks(spark, tmp_path):
    rows = [(f"r {i % 40}", i % 3, f"line {i} é") for i in range(600)] + [(None, 0, None)]
    df = spark.createDataFrame(rows, "dir string, stretch long, value string")
    for _ in range(2):  # a second try leaves the same files
        files.write_directories(df, f"{tmp_path}/own")
    df.drop("stretch").write.partitionBy("dir").text(f"{tmp_path}/spark")
    own, theirs = (sorted((r["dir"] or "", r["value"]) for r in spark.read.text(f"{tmp_path}/{k}").collect()) for k in ("own", "spark"))
    assert own == theirs and len(own) == 601
    found = sorted(p for p in (tmp_path / "own").glob("*/*"))
    assert len(found) == 121 and all(p.suffix == ".txt" for p in found)
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with files._few_listing_tasks(spark):
        assert int(spark.conf.get(key)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before
