"""Nulls, blanks, repeated rows, clashing columns and empty tables, and small brute-force comparisons."""

import hashlib
import math
import os
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import class_lm, decontamination, embedding_join, graph, licenses, minhash, packing, pii, quality, repeats, sharding
from tidelog.llm.scratch import Scratch

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(60)]
BASE = " ".join(rng.choice(WORDS) for _ in range(150))


def variant(n):
    w = BASE.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
    return " ".join(w)


PASSAGE = " ".join(f"passage{i}" for i in range(80))
TEXTS = [None, "", " \n ", "one two", "One  TWO", BASE, BASE, variant(1), variant(2), variant(8), "lone " + PASSAGE, PASSAGE + " other end", "mail a.b@c.de or 10.0.0.1 and 4111 1111 1111 1111, +49 30 1234567 é", "x" * 5000, "word " * 30_000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, text_key string, part int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", len(t or ""), None, "k", 1) for i, t in enumerate(TEXTS)] + [(5, BASE, "en", None, None, 1.0, None, 2), (None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(15)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs):
    rows = [r for r in minhash.near_duplicates(docs).collect()]
    assert len(rows) == len(TEXTS) + 2
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], r["doc_id"] == root[r["doc_id"]])
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([i for i in root if root[i] == i] + [None])


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs, with_ids=True).where("doc_id is not null").collect()
    for r in rows:
        ids = whole.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        own = ids[r["start"] : r["start"] + r["length"]]
        assert own == r["ids"] and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
    seats = {}
    for r in packing.pack(docs).collect():
        seats.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seats.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    shift = [(100 + i, f"{'ab' * i} {rng.random()} {PASSAGE[: 700 - 9 * i]} {rng.random()}", None, None, None, None, None, None) for i in range(40)]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(shift, SCHEMA))
    data = [(r[0], r[1].encode()) for r in shift] + [(i, (t or "").encode()) for i, t in enumerate(TEXTS)] + [(5, BASE.encode()), (None, b"no id here")]
    def covered(units, length, seen):
        gone = bytearray(len(units))
        for p in range(len(units) - length + 1):
            if seen[units[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        return gone

    words = [tuple(b.split()) for _, b in data]
    seen = Counter(b[i : i + 400] for _, b in data for i in range(len(b) - 399))
    passages = Counter(w[i : i + 50] for w in words for i in range(len(w) - 49))
    want = Counter()
    for (i, b), w in zip(data, words, strict=True):
        gone = covered(b, 400, seen)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest(), sum(covered(w, 50, passages))] += 1
    assert Counter(tuple(r) for r in repeats.without_repeats(docs).collect()) == want


def test_benchmark(docs, benchmark):
    assert {r["doc_id"] for r in decontamination.benchmark_matches(docs, benchmark).collect()} == {10, 11}
    assert decontamination.without_benchmark(docs, benchmark).count() == len(TEXTS)


def test_personal_data(docs):
    rows = {r["doc_id"]: r for r in pii.personal_data_digest(docs).collect()}
    one = rows[12]
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (1, 1, 1, 1)
    base = "email:5:13,ip:17:25,card:30:49,phone:51:65"
    assert one["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and rows[0]["spans"] == ""
    assert {r["doc_id"]: r["text"] for r in pii.without_personal_data(docs).collect()}[12] == "mail <EMAIL> or <IP> and <CARD>, <PHONE> é"


def test_secrets_by_long_or_quoted_keys_and_around_cards(spark):
    digits = next(f"{n:016d}" for n in range(4111_0000_0000_0000, 4111_0000_0000_0100) if sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(f"{n:016d}")))) % 10 == 0)
    texts = {
        1: "aws_secret_access_key = wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEY1 end",
        2: '{"password": "hunter2hunter2"}',
        3: f"token=deadbeef{digits}cafebabe end",
        4: "password=hunter2hunter2 end",
        5: f"token={digits} end",
        6: "call +1 (555) 123-4567 now",
    }
    found = pii.without_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {
        1: "<SECRET> end", 2: '{"<SECRET>"}', 3: "<SECRET> end", 4: "<SECRET> end", 5: "token=<CARD> end", 6: "call <PHONE> now",
    }


def test_language_scores(docs):
    rows = class_lm.language_scores(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r["score"] <= 0 and r["n_known"] <= r["n_tokens"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 2)} == {1}


def test_language_counts_against_brute_force(docs):
    words = lambda text: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, t in given if not held_out(i) for w in words(t))
    tokens, low = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    key = lambda r: (-1 if r[0] is None else r[0], r[2])
    expected = sorted(((i, held_out(i), len(words(t)), sum(count[w] > 0 for w in words(t)), tokens, sum(math.log10((count[w] + 0.5) / low) for w in words(t))) for i, t in given), key=key)
    found = sorted((tuple(r)[:6] for r in class_lm.language_scores(docs).collect()), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in expected] and any(r[1] for r in found)
    assert [r[5] for r in found] == pytest.approx([r[5] for r in expected])


def test_quality(docs, labels):
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["score"] == 1 for r in quality.quality(docs, labels.limit(0)).collect())


def test_licenses(spark, docs):
    assert licenses.license_matches(docs).count() == 0
    held = spark.createDataFrame([(1, "x\nReleased under the MIT License.\n")], "doc_id long, text string")
    assert [(r["license"], r["first_line"]) for r in licenses.license_matches(held).collect()] == [("MIT", 1)]


def test_licenses_across_and_within_lines(spark):
    grant = licenses.TEMPLATES["MIT"][2]
    texts = {
        1: "intro here\n" + textwrap.fill(grant, 72) + "\n\nbye",
        2: "Copyright (c) 2021 Acme Corp. All rights reserved.",
        3: "This tool is made available to all and is licensed under the MIT License.",
        4: "some prose, then " + grant + " " + PASSAGE,
        5: "one\nAll rights\nreserved. And later:\nAll rights reserved.",
        6: "all the rights are reserved\nunder the licence of the mit",
    }
    found = licenses.license_matches(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"], r["dice"], r["n_lines"], r["first_line"]) for r in found) == [
        (1, "MIT", 1.0, 1, 1), (2, "all-rights-reserved", 1.0, 1, 0), (3, "MIT", 1.0, 1, 0), (4, "MIT", 1.0, 1, 0), (5, "all-rights-reserved", 1.0, 2, 1),
    ]


def test_license_runs_against_brute_force(spark):
    draw, texts = random.Random(7), {}
    for i in range(40):
        words = licenses.plain_words(draw.choice([t for own in licenses.TEMPLATES.values() for t in own]))
        words = [draw.choice(["the", "x", w]) if draw.random() < 0.1 else w for w in words if draw.random() > 0.05]
        texts[i] = "".join(w + draw.choice(" \n   ") for w in ["lead"] * draw.randrange(1, 30) + words + ["tail"] * draw.randrange(1, 30))
    expected = {}
    for i, text in texts.items():
        w = licenses.plain_words(text)
        b = [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]
        for name, t in licenses.template_rows():
            sets = (set(b[a : a + n]) for a in range(len(b)) for n in range(1, len(t) * 3 // 2 + 1))
            top = max(2.0 * len(s & set(t)) / (len(s) + len(t)) for s in sets)
            if top >= licenses.DICE:
                expected[i, name] = max(top, expected.get((i, name), 0))
    found = licenses.license_matches(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in found} == set(expected) and len(expected) > 20
    assert all(r["dice"] <= expected[r["doc_id"], r["license"]] for r in found)


def test_sharding(docs):
    store = sharding.sharded(docs, target_bytes=4096)
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, docs.collect()))
    assert sharding.contents(store, docs).where("not settled").count() == 0


def test_store_tiers_versions_and_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = sharding.ShardStore(spark, root, target_bytes=64 << 10)
    rows = lambda a, b: spark.range(a, b).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1)
    for i in range(5):
        store.append(rows(100 * i, 100 * i + 100))
    assert store.version() == 5 and len(store.manifest()) == 5 and len(store.manifest(2)) == 2
    before = {s.path for s in store.manifest()}
    assert store.compact() == 6 and len(store.manifest()) == 1 and not {s.path for s in store.manifest()} & before
    assert sorted(r["id"] for r in store.read().collect()) == list(range(500)) and store.read(3).count() == 300
    # A writer that dies after its claim blocks others only for a while.
    store._fs.createNewFile(store._hadoop.Path(f"{root}/manifest/{7:012d}.claim-0"))
    with pytest.raises(sharding.ConcurrentCommit):
        store.append(rows(500, 510))
    patient = sharding.ShardStore(spark, root, target_bytes=64 << 10, claim_seconds=0)
    assert patient.append(rows(500, 510)) == 7 and patient.read().count() == 510
    # Of two writers after one version, one fails; vacuuming spares what a writer is about to commit.
    late = store._written(rows(510, 520))
    store.vacuum()
    assert store._commit(store.manifest(7) + late, 7) == 8 and store.read().count() == 520
    with pytest.raises(sharding.ConcurrentCommit):
        store._commit(store.manifest(7), 7)
    store.vacuum(grace_seconds=0)
    assert store.read().count() == 520 and store.version() == 8
    empty = sharding.sharded(spark.range(0).selectExpr("id as doc_id", "'' as text"))
    assert sharding.contents(empty, spark.range(0).selectExpr("id as doc_id", "'' as text")).count() == 0


def test_multikey_order_against_sorting(spark):
    draw = random.Random(4)
    data = bytes(draw.choice(b"ab\x00\xff") for _ in range(3000)) * 2
    units = np.frombuffer(data, np.uint8)
    starts = np.array(draw.sample(range(len(data) - 40), 800))
    keys, step = repeats.BYTES.keys(units)
    order, equal = repeats.multikey_order(keys, starts, 40, step)
    found = [data[s : s + 40] for s in starts[order]]
    assert found == sorted(found) and equal.tolist() == [i > 0 and found[i] == found[i - 1] for i in range(len(found))] and equal.any()


def test_long_words_that_sums_confuse(spark):
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    rows = packing.pack(spark.createDataFrame([(1, thue), (2, other)], "doc_id long, text string")).collect()
    assert len({r["ids_crc32"] for r in rows if r["piece"] == 0}) == 2


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [1.0, 0.0], None), (8, [2.0, 0.0], 1), (8, [0.0, 1.0], 1), (9, [None, 1.0], 1)]
    found = embedding_join.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (8, 2, 1), (9, 0, 9)]


def test_empty_tables(spark, docs, labels, benchmark):
    none = docs.limit(0)
    for found in (minhash.near_duplicates(none), packing.pack(none), repeats.without_repeats(none), decontamination.benchmark_matches(none, benchmark), pii.personal_data_digest(none), class_lm.language_scores(none), quality.quality(none, labels), licenses.license_matches(none)):
        assert found.count() == 0


def test_stages_keep_clashing_columns_and_blank_rows(spark, labels, benchmark):
    names = ["_row_key", "_id", "_group", "_key", "_bad_id", "row_id", "row_key", "no_id", "new_text", "f", "base", "spans", "blank", "a", "cid"]
    rows = [(None, "", *names), (None, " ", *names), (1, "", *names), (1, " ", *names), (2, None, *names), (3, "mail a.b@c.de now", *names), (4, PASSAGE, *names), (4, PASSAGE, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = sorted(map(tuple, docs.collect()), key=repr)
    assert sorted(map(tuple, minhash.without_near_duplicates(docs).collect()), key=repr) == sorted(set(kept), key=repr)
    assert sorted(map(tuple, quality.accepted(docs, labels.limit(0)).collect()), key=repr) == kept
    assert sorted(map(tuple, decontamination.without_benchmark(docs, benchmark).collect()), key=repr) == [r for r in kept if r[0] != 4]
    assert sorted(map(tuple, pii.without_personal_data(docs).collect()), key=repr) == sorted(((r[0], "mail <EMAIL> now", *r[2:]) if r[0] == 3 else r for r in kept), key=repr)


def test_items_without_id_and_windows_of_repeats(spark):
    item = " ".join(f"head{i}" for i in range(60)) + " dull" * 40
    text = " ".join(f"head{i}" for i in range(60)) + " gray" * 8 + " dull" * 32
    docs = spark.createDataFrame([(1, text), (2, "other text of few words")], "doc_id long, text string")
    asked = spark.createDataFrame([(None, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_matches(docs, asked).collect()] == [(1, None)]
    assert [r["doc_id"] for r in decontamination.without_benchmark(docs, asked).collect()] == [2]


def test_components_against_brute_force(spark, monkeypatch):
    draw = random.Random(3)
    for n, alone in ((60, 100), (60, 0), (0, 100)):
        monkeypatch.setattr(graph, "ALONE", alone)
        edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(n)] + ([(i, i + 1) for i in range(100, 140)] if n else []) + [(None, 5), (7, 7)]
        draw.shuffle(edges)
        root = {x: x for a, b in edges if a is not None and a != b for x in (a, b)}
        for _ in root:
            for a, b in edges:
                if a in root and b in root:
                    root[a] = root[b] = min(root[a], root[b])
        df = spark.createDataFrame(edges, "a long, b long").repartition(7)
        found = graph.components(df, Scratch(spark, "test"), "c").collect()
        assert sorted(map(tuple, found)) == sorted(root.items())


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{i}@mail{i}.org" for i in range(3000))
    row = pii.personal_data_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text))
    assert row["n_email"] == 3000 and row["spans"] == spans and row["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


def test_pipeline_stages(spark, docs, labels, benchmark, tmp_path):
    for name, df in (("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_pipeline_rows_against_brute_force(spark, benchmark, tmp_path, monkeypatch):
    class Kept(corpus_pipeline.Scratch):
        def keep(self, df, name):
            tables[name] = super().keep(df, name)
            return tables[name]

    tables = {}
    monkeypatch.setattr(corpus_pipeline, "Scratch", Kept)
    given = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 13), 0) for i in range(15)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", given), ("labels", marks), ("benchmark", benchmark)):
        df.write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = {name: {r["doc_id"]: r["text"] for r in df.collect()} for name, df in tables.items()}

    good = {r["doc_id"] for r in quality.quality(given, marks).collect() if r["predicted"]}
    expected = {i: t for i, t in enumerate(TEXTS) if i in good}
    assert rows["quality"] == expected and {5, 6, 10, 12} <= good
    sets = {i: shingles(t) for i, t in expected.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * max(1, len(sets[a] | sets[b])):
                    root[a] = min(root[a], root[b])
    expected = {i: t for i, t in expected.items() if root[i] == i}
    assert rows["near_duplicates"] == expected and 6 not in expected
    expected = {i: t for i, t in expected.items() if PASSAGE not in (t or "")}
    assert rows["decontamination"] == expected and 10 not in expected
    expected[12] = "mail <EMAIL> or <IP> and <CARD>, <PHONE> é"
    assert rows["personal_data"] == expected
    assert {r["doc_id"] for r in placed} == set(expected)
    used = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= packing.CAPACITY
    for i in expected:
        own = sorted((r["piece"], r["start"], r["length"]) for r in placed if r["doc_id"] == i)
        assert [start for _, start, _ in own] == [sum(n for *_, n in own[:k]) for k in range(len(own))] and [p for p, *_ in own] == list(range(len(own)))
