"""Whole small tables against plain Python: personal data, packing, and held-out accuracy of the classifier."""

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter

import pytest

from tidelog.llm import packing, pii, queries

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = ["1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "a@b.c@d.e.f x@y .@-.-", "+1 (2) 3-4.5 6789012 +123456789012345678", "4111-1111 1111 1111 4111111111111112 0 0 0", "++49 30 1234567", "é 10.0.0.1é", None, ""]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": all(int(x) <= 255 for x in text.split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def test_personal_data_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = dict(map(tuple, docs.collect()))
    rows = pii.personal_data_digest(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [f"{kind}:{m.start()}:{m.end()}" for kind, p in PATTERNS.items() for m in re.finditer(p, texts[r["doc_id"]] or "") if good(kind, m[0])]
        counts = Counter(x.split(":")[0] for x in base)
        assert [r[f"n_{k}"] for k in PATTERNS] == [counts[k] for k in PATTERNS], texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(filter(None, r["spans"].split(",")))
        assert r["n_private"] == len(list(filter(None, r["spans"].split(",")))) == len(base) + r["n_added"]


@pytest.mark.parametrize("capacity", [2048, 37])
def test_packing_needs_no_more_sequences_than_best_fit(spark, capacity):
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), capacity=capacity).collect()
    gaps, used = [], 0
    for n in sorted((r["length"] for r in rows), reverse=True):
        i = bisect_left(gaps, n)
        if i < len(gaps):
            gap = gaps.pop(i)
        else:
            gap, used = capacity, used + 1
        insort(gaps, gap - n)
    assert len({r["sequence_id"] for r in rows}) == used


def test_classifier_on_labels_it_has_not_seen(spark):
    found = {r["doc_id"]: r for r in queries.op10_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = [(found[r["doc_id"]], r["quality"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r["doc_id"] in found and r["quality"] is not None]
    unseen = [(r["predicted"], q) for r, q in labels if r["held_out"]]
    assert len(unseen) > 30 and sum(p == q for p, q in unseen) >= 0.9 * len(unseen)
