"""Each stage of the pipeline by content, against plain versions, and on awkward tables."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from thicket.llm.queries import word_bpe

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not there")
A = " ".join(f"w{i}" for i in range(60))
B = " ".join(f"v{i}" for i in range(60))
ROWS = [
    (1, A, "x", 1), (1, B, "x", 2), (1, A, "x", 1), (2, B + " tail", "y", 3), (3, A + " end", "y", 4),
    (None, A, "z", 5), (None, None, "z", 6), (4, None, None, None), (5, "", "z", 7), (6, " ".join(f"u{i}" for i in range(9000)), "z", 8),
]
SCHEMA = "doc_id long, text string, id string, n_words int"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_different_texts_of_one_id_stay(spark, awkward):
    got = sorted(map(tuple, cp.near_duplicates(spark, awkward, SF).collect()), key=repr)
    stay = [(1, A, "x", 1), (1, B, "x", 2), (None, A, "z", 5), (None, None, "z", 6), (4, None, None, None), (5, "", "z", 7), ROWS[-1]]
    assert got == sorted(stay, key=repr)


@pytest.mark.parametrize("name,apply", cp.STAGES)
def test_stages_take_awkward_tables(spark, awkward, name, apply):
    out = apply(spark, awkward, SF)
    if name != cp.STAGES[-1][0]:
        assert out.columns == awkward.columns
    assert apply(spark, awkward.limit(0), SF).count() == 0
    rows = out.collect()
    if name in ("personal_data", "bpe_encoding"):
        assert len(rows) == len(ROWS)
    if name == "quality_rules":
        assert {r.doc_id for r in rows} == {1, 2, 3, 6, None}


def test_stages_by_content(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in cp.quality_rules(spark, docs, SF).collect()}
    for doc, text in before.items():
        w = text.encode().split()
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        again = {i + o for places in seen.values() if len(places) > 1 for i in places for o in range(3)}
        chars = len(b"".join(w).decode())
        bad = len(w) < 50 or 100 * len(again) > 50 * len(w) or 10 * sum(c in "#*$%&|<>" for c in text) > len(w) or chars < 2 * len(w) or chars > 15 * len(w)
        assert (doc in kept) != bad and kept.get(doc, text) == text
    plain = Tokenizer.from_file(word_bpe())
    for r in cp.bpe_encoding(spark, docs, SF).collect():
        ids = plain.encode(before[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.decoded == plain.decode(ids, skip_special_tokens=False)


def test_decontamination_by_content(spark):
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0")
    items = [r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    phrases = {}
    for text in items:
        w = word.findall(lower(text))
        size = min(len(w), 10)
        for i in range(len(w) - size + 1 if w else 0):
            phrases.setdefault(size, set()).add(tuple(w[i : i + size]))
    got = {r.doc_id: r.text for r in cp.decontamination(spark, docs, SF).collect()}
    for r in docs.collect():
        w = word.findall(lower(r.text))
        hit = {i + o for size, some in phrases.items() for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in some for o in range(size)}
        if w and len(hit) == len(w):
            assert r.doc_id not in got
        else:
            assert word.findall(lower(got[r.doc_id])) == [x for i, x in enumerate(w) if i not in hit]
            assert hit or got[r.doc_id] == r.text


def test_licences_inside_a_paragraph_are_found(spark):
    from thicket.llm import queries as Q

    text = "Intro sentence about this. Released under the MIT License. More words follow here."
    path = spark.createDataFrame([(1, text)], "doc_id long, text string")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/licence-{hashlib.md5(text.encode()).hexdigest()}"
    path.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert Q.op7_license_scan(spark, folder).select(F.col("licenses")).first()[0] == "MIT"
