"""Every registered query of the training-data operators against its SQL oracle or a brute-force version."""

import base64
import hashlib
import os

import numpy as np
import pytest

from thicket.llm import queries as Q

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(Q.ORACLES))
def test_matches_oracle(spark, duck, key):
    df = Q.QUERIES[key](spark, SF)
    result = duck.execute(Q.ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want


def test_warc_round_trip(spark, duck):
    got = {r.page_id: r for r in Q.op1_warc(spark, SF).collect()}
    pages = duck.execute("SELECT page_id, coalesce(html, '') FROM pages ORDER BY page_id").fetchall()
    first = {}
    for page, html in pages:
        first.setdefault(html, page)
    assert len(got) == len(pages)
    for page, html in pages:
        data, lead = html.encode(), first[html]
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if lead == page else ("revisit", lead))
        assert lead != page or r.payload_sha1 == hashlib.sha1(data).hexdigest()


def test_bpe_equals_the_library(spark, duck):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(Q.word_bpe())
    got = {r.doc_id: r for r in Q.op9_bpe(spark, SF).collect()}
    for doc, text in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = plain.encode(text, add_special_tokens=False).ids
        decoded = plain.decode(ids, skip_special_tokens=False)
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_html_and_pii_give_every_row(spark, duck):
    n = duck.execute("SELECT count(*) FROM pages").fetchone()[0]
    pages = Q.op3_html_text(spark, SF).collect()
    assert len(pages) == n and not any("<p>" in r.text or "track(" in r.text for r in pages)
    rows = Q.op10_pii(spark, SF).collect()
    old = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert len(rows) == len(old)
    for r in rows:
        for f in r.found:
            assert old[r.doc_id][f.start : f.end] != f.pseudonym and len(f.pseudonym) > 0
        assert r.n_found or r.text == old[r.doc_id]


def test_pipeline_against_brute_force(spark, duck):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else None
        docs = apply(spark, docs, SF).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            sets = {}
            for doc, text in before.items():
                w = text.encode().lower().split()
                sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
            group = {d: d for d in sets}
            near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            for _ in sets:
                for a, b in near:
                    group[a] = group[b] = min(group[a], group[b])
            assert set(after) == {d for d in group if group[d] == d}
        elif name == "personal_data":
            assert {d: r.text for d, r in after.items()}.keys() == before.keys()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(after)
