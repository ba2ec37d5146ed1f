"""Packages, corpora, template tables and declared zones under revisions."""

import json
import os
import shutil
from datetime import UTC, datetime

import pytest

from tidelog import packages, state
from tidelog.shared import fresh_folder


def test_package_there_and_back(spark, tmp_path):
    root = str(tmp_path / "p")
    tables = {"events": spark.range(1000).selectExpr("id AS seq", "id % 7 AS k").repartition(3), "templates": spark.range(3)}
    packages.export(tables, root, ("stats", "later_feature"))
    back = packages.load(spark, root)
    assert set(back) == set(tables) and back["events"].exceptAll(tables["events"]).count() == 0 and packages.problems(spark, root).count() == 0
    with pytest.raises(packages.Damaged):
        packages.export(tables, root)
    with pytest.raises(packages.Damaged):
        packages.export({"../x": tables["events"]}, str(tmp_path / "q"))
    files = sorted(f for f in os.listdir(f"{root}/data/events") if f.endswith(".parquet"))

    def damaged(change):
        copy = str(tmp_path / f"c{len(os.listdir(tmp_path))}")
        shutil.copytree(root, copy)
        change(copy)
        with pytest.raises(packages.Damaged):
            packages.load(spark, copy)

    def header(**more):
        def change(at):
            found = json.load(open(f"{at}/package.json")) | more
            os.remove(f"{at}/.package.json.crc")
            json.dump(found, open(f"{at}/package.json", "w"))

        return change

    first = lambda at: f"{at}/data/events/{files[0]}"
    damaged(lambda at: os.remove(first(at)))
    damaged(lambda at: shutil.copy(first(at), f"{at}/data/events/extra.parquet"))
    damaged(lambda at: (os.remove(f"{at}/data/events/.{files[0]}.crc"), shutil.copy(f"{at}/data/events/{files[1]}", first(at))))
    damaged(lambda at: os.remove(f"{at}/package.json"))
    damaged(header(min_reader=2))
    damaged(header(tables={"events": 999, "templates": 3}))
    damaged(header(tables={}))
    header(features=["unknown"])(root)
    assert len(packages.load(spark, root)) == 2


def test_catalog(spark, tmp_path):
    c = packages.Catalog(spark, str(tmp_path / "corpora"))
    assert c.corpora() == []
    a, b = c.create("beta "), c.create("alpha")
    assert [x.name for x in c.corpora()] == ["alpha", "beta"]
    assert c.rename(a.corpus_id, "aaa").name == "aaa" == c.open(a.corpus_id).name
    c.discard(b.corpus_id)
    assert c.corpora() == [c.open(a.corpus_id)]
    for bad in ("..", b.corpus_id):
        with pytest.raises(LookupError):
            c.open(bad)
    with pytest.raises(ValueError):
        c.create(" ")


def test_templates(spark):
    v = state.Versioned(spark, fresh_folder(spark, "templates"))
    rows = lambda *r: spark.createDataFrame(r, "template_id long, pattern string")
    state.upsert_templates(v, rows((1, "a <*>"), (2, "b")), 0)
    state.upsert_templates(v, rows((2, "b <*>"), (3, "c")), 1)
    assert {tuple(r) for r in v.read().collect()} == {(1, "a <*>"), (2, "b <*>"), (3, "c")}
    for bad in (((4, "x"), (4, "y")), ((None, "x"),)):
        with pytest.raises(state.Conflict):
            state.upsert_templates(v, rows(*bad), 2)


def test_declared_zones(spark):
    local = int(datetime(2024, 11, 3, 1, 30, tzinfo=UTC).timestamp())
    rows = [(1, "a", None, local, None, "unresolved_local"), (2, "a", None, local, "CST", "unresolved_local"), (3, "a", 77, local, None, "explicit_wall"), (4, "b", None, local, None, "unresolved_local"), (5, "a", None, None, None, "order_only"), (6, None, None, local, None, "unresolved_local")]
    v = state.Versioned(spark, fresh_folder(spark, "zoned"))
    state.append(v, spark.createDataFrame(rows, "seq long, source string, ts long, local long, abbreviation string, basis string"), 0)
    told = lambda: {r.seq: (r.ts, r.basis) for r in v.read().collect()}
    before = told()
    done = state.apply_zones(v, {"a": "America/Chicago"}, 1)
    assert done.note["reasons"] == {"fold": 1, "resolved": 1}
    assert told() == before | {2: (local + 6 * 3600, "resolved_local")}
    state.apply_zones(v, {"a": "Asia/Kolkata", "b": "Asia/Kolkata"}, 2)
    assert told() == before | {1: (local - 19800, "resolved_local"), 4: (local - 19800, "resolved_local")}
    state.clear_zone(v, "a", 3)
    assert told() == before | {4: (local - 19800, "resolved_local")}
    v.undo(4)
    assert told()[1] == (local - 19800, "resolved_local")
    for bad in (lambda: state.clear_zone(v, "c", 5), lambda: state.apply_zones(v, {"a": "Nowhere/Land"}, 5), lambda: state.apply_zones(v, {"a": "UTC"}, 4)):
        with pytest.raises(state.Conflict):
            bad()
