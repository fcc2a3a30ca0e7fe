"""Files cut into many byte ranges give the same records, lines and errors as whole ones."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docmeter.operators import logs
from docmeter.sources import files


@pytest.fixture
def ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def log_lines(seed, n):
    r = random.Random(seed)
    out = ["noise before any record", "KeyError: lost"] if seed % 2 else []
    while len(out) < n:
        out.append(f"2024-01-01 00:00:{len(out) % 60:02d},{len(out)} ERROR app.error: message {r.randrange(4)}")
        for _ in range(r.choice([0, 0, 1, 3, 60])):
            out.append(r.choice(["  File x, line 3", "ValueError: a", "pkg.IOException: b", "plain words", "", "KeyError"]))
    return out


def slow_records(lines):
    out = []
    for line in lines:
        if m := re.match(logs.START, line):
            out.append([m[1], m[2], None])
        elif out and (m := re.match(logs.EXCEPTION, line.strip())):
            out[-1][2] = m[1]
    return sorted(map(tuple, out), key=str)


def test_log_records_of_many_ranges(spark, tmp_path, ranges):
    for seed in (1, 2):
        (tmp_path / f"app{seed}.log").write_text("\n".join(log_lines(seed, 900)) + "\n")
    lines = files.numbered_lines(spark, str(tmp_path))
    assert lines.select("file", "split").distinct().count() > 20
    got = sorted(((r["ts"], r["message"], r["exception"]) for r in logs.records(lines).collect()), key=str)
    assert got == sorted(slow_records(log_lines(1, 900)) + slow_records(log_lines(2, 900)), key=str)
    assert "Window" in logs.records(lines)._jdf.queryExecution().toString()


def test_records_by_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(logs, "SPLIT_LINES", 7)
    lines = log_lines(3, 300)
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    assert sorted(((r["ts"], r["message"], r["exception"]) for r in logs.records(df).collect()), key=str) == slow_records(lines)


def test_line_numbers(spark, tmp_path, ranges):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(500)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    got = files.numbered_lines(spark, str(tmp_path / "a.txt"))
    assert [(r["line_no"], r["line"]) for r in got.orderBy("line_no").collect()] == list(enumerate(lines, 1))


def test_json_lines_of_many_ranges(spark, tmp_path, ranges):
    items = [{"id": i, "text": "é" * (i % 50)} for i in range(300)]
    (tmp_path / "good.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) + ("\n" if x["id"] % 9 == 0 else "") for x in items))
    got = files.benchmark(spark, str(tmp_path / "good.jsonl"))
    assert got.rdd.getNumPartitions() > 5
    assert sorted(r["id"] for r in got.select(F.variant_get("item", "$.id", "int").alias("id")).collect()) == list(range(300))
    (tmp_path / "bad.jsonl").write_text("\n".join(json.dumps(x) for x in items) + "\n{not json\n")
    with pytest.raises(ValueError, match="bad.jsonl: line 301 "):
        files.benchmark(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "list.json").write_text(json.dumps(items, indent=1))
    assert files.benchmark(spark, str(tmp_path / "list.json")).count() == 300
