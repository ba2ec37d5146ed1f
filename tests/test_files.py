"""Reading files against plain Python."""

import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidelog.sources import files


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "logs"
    (root / "b").mkdir(parents=True)
    (root / ".git").mkdir()
    contents = {
        "a.log": b"one\r\ntwo\n\nfour\xff\n", "b/long.log": b"x" * (5 << 20) + b"\nshort", "b/many.log": b"".join(b"line %d \xc3\xa9\n" % i for i in range(300_000)), "b/end.log": b"last without feed", "empty.log": b"", "feeds.log": b"\n\n",
    }
    for name, data in contents.items():
        (root / name).write_bytes(data)
    (root / ".hidden").write_bytes(b"no")
    (root / ".git" / "x").write_bytes(b"no")
    (root / "_SUCCESS").write_bytes(b"no")
    os.symlink(root / "a.log", root / "link.log")
    return root, contents


def test_inventory(spark, folder):
    root, contents = folder
    found = {r.name: (r.n_bytes, r.status) for r in files.inventory(spark, str(root)).collect()}
    assert found == {n: (len(d), "file") for n, d in contents.items()} | {".hidden": (0, "hidden"), ".git": (0, "hidden"), "_SUCCESS": (0, "reserved"), "link.log": (0, "symlink")}
    paths = [r.path for r in files.inventory(spark, str(root)).collect()]
    assert paths == sorted(paths)
    with pytest.raises(files.LimitExceeded):
        files.inventory(spark, str(root), max_entries=3)
    with pytest.raises(files.LimitExceeded):
        files.inventory(spark, str(root), max_bytes=1000)
    with pytest.raises(ValueError):
        files.inventory(spark, str(root / "link.log"))
    assert [r.name for r in files.inventory(spark, str(root / "a.log")).collect()] == ["a.log"]


def test_lines_of_splits(spark, folder):
    root, contents = folder
    paths = [r.path for r in files.inventory(spark, str(root)).where("status = 'file'").collect()]
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        limit = 1 << 20
        found = files.lines(spark, paths, limit)
        assert found.rdd.getNumPartitions() > 1 or found.count()
        got: dict = {}
        for r in found.collect():
            got.setdefault(os.path.basename(r.source), []).append((r.line_no, r.line, r.n_bytes, r.truncated))
        digests = {os.path.basename(r.source): r for r in files.digests(spark, paths).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    for name, data in contents.items():
        want = data.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        lines = [(i, x[:limit].decode("utf-8", "replace").removesuffix("\r"), len(x), len(x) > limit) for i, x in enumerate(want)]
        base = os.path.basename(name)
        assert sorted(got.get(base, [])) == lines, name
        if data:
            assert (digests[base].sha256, digests[base].n_bytes, digests[base].n_lines) == (hashlib.sha256(data).hexdigest(), len(data), len(want)), name
    assert "empty.log" not in digests


def test_archives_besides_files(spark, folder):
    root, contents = folder
    with zipfile.ZipFile(root / "more.ZIP", "w") as z:
        z.writestr("in/a.log", "first\nsecond\n")
        z.writestr("../out.log", "no")
    found = files.ingested(spark, str(root))
    inside = found.where(F.col("source").contains("!/")).collect()
    assert sorted((r.source.split("!/")[1], r.line_no, r.line) for r in inside) == [("in/a.log", 0, "first"), ("in/a.log", 1, "second")]
    assert found.where(F.col("source").endswith("a.log") & ~F.col("source").contains("!/")).count() == 4
    assert files.ingested(spark, str(root / "more.ZIP")).count() == 2
