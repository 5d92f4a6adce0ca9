"""Frames, source mixing and the filter audit on small cases, against brute force."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.llm import fim_frames, filter_audit, source_mix
from thicket.llm import queries as Q

LONG = " ".join(f"wört{i % 977}" for i in range(40_000))
#: doc_id, text, source, lang, and columns that clash with names used inside
ROWS = [
    (1, "a b c d", "x", "en", "k", 0),
    (1, "a b c d", "x", "en", "k", 0),
    (2, None, None, None, None, None),
    (3, "", "x", "", "k", 1),
    (4, " \t\n", "y", "de", "k", 1),
    (None, "a b c d", "x", "en", "k", 2),
    (None, None, None, None, None, None),
    (5, LONG, "y", "en", "k", 3),
    (6, "héllo <S> wörld 𝄞 $", "y", "de", "k", 3),
    (7, "X" * 200_000, "z", "de", "k", 4),
]
SCHEMA = "doc_id long, text string, source string, lang string, frames string, id int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def plain_fim(doc, text, seed=1):
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    out = f"<S>{s}<P>{p}<M>{m}" if d % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if d % 100 < 20 else "psm", lo, hi - lo, out


@pytest.mark.parametrize("frame_units", [7, 1000, fim_frames.FRAME_UNITS])
def test_fim_cases(docs, frame_units):
    done = fim_frames.fill_in_middle(fim_frames.store_frames(docs, frame_units=frame_units)).collect()
    got = sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, fim_frames.output_text([f.asDict() for f in r.output])) for r in done), key=repr)
    assert got == sorted(((r[0], *plain_fim(r[0], r[1] or "")) for r in ROWS), key=repr)


def test_fim_digests(docs):
    rows = fim_frames.digests(fim_frames.fill_in_middle(fim_frames.store_frames(docs, frame_units=50))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.id, r.output_sha256, r.restored_sha256) for r in rows), key=repr) == sorted(
        ((r[0], sha(plain_fim(r[0], r[1] or "")[-1]), sha(r[1] or "")) for r in ROWS), key=repr
    )
    assert fim_frames.fill_in_middle(fim_frames.store_frames(docs.limit(0))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>PSM aé𝄞", max_size=60), st.integers(1, 9), st.sampled_from(["psm", "spm"]), st.randoms())
def test_fim_round_trip(text, units, form, rng):
    import zstandard

    if any(m in text for m in fim_frames.MARKS):
        return
    pack = zstandard.ZstdCompressor().compress
    pieces = [text[i : i + units] for i in range(0, len(text), units)]
    frames = [dict(zip(("start", "units", "data"), f)) for f in fim_frames.numbered([(len(p), pack(p.encode())) for p in pieces])]
    a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
    out = [dict(zip(("start", "units", "data"), f)) for f in fim_frames.arranged(frames, len(text), form, a, b)]
    want = {"psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
    assert fim_frames.output_text(out) == want
    assert b"".join(fim_frames.restored(out, form)).decode() == text
    whole = {f["data"] for f in frames[1:-1] if not (f["start"] <= a < f["start"] + f["units"] or f["start"] <= b < f["start"] + f["units"])}
    assert whole <= {f["data"] for f in out}  # frames without a cut are not compressed anew


def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(w for t, w in weight.items() if t not in full) for s in names if s not in full}
        over = {s for s, v in share.items() if v > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in full}
        full |= over


def test_targets_equal_the_plain_loop(spark):
    rng = random.Random(5)
    sizes = {None: 40, "": 0, "ä": 7, "z": 900, **{f"s{i}": rng.randint(1, 3000) for i in range(25)}}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_mix.source_targets(df, (1, 2, 3), 3).collect()}
    want = plain_targets(sizes, (1, 2, 3), 3)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-12) for s in want)


def mixed_table(spark, parts):
    rng = random.Random(3)
    rows = []
    for source, count, longest in (("a", 900, 400), ("b", 150, 60), (None, 80, 2000), ("c", 5, 30), ("d", 40, 5)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randint(0, longest)), source) for i in range(count)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts, "doc_id")


def test_mix_solves_the_dual_and_meets_targets(spark):
    out = source_mix.mix_sources(mixed_table(spark, 5)).collect()
    again = source_mix.mix_sources(mixed_table(spark, 2)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    want = plain_targets({s: sum(r.size for r in rows) for s, rows in by.items()}, (1, 2, 3), 3)
    for source, rows in by.items():
        target, words = want[source], sum(r.size for r in rows)
        assert all(math.isclose(r.target, target, rel_tol=1e-12) and r.source_size == words for r in rows)
        assert math.isclose(sum(r.rate * r.size for r in rows), target, rel_tol=1e-6)
        # one multiplier gives all rates below the cut, and the cut only stops larger ones
        tilt = [math.log(r.rate) / r.size for r in rows if r.size and r.rate < 3]
        assert not tilt or max(tilt) - min(tilt) < 1e-9
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 and abs(r.copies - r.rate) < 2 for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= max(0.01 * target, min(r.size for r in rows if r.size))


def test_mix_cases(docs):
    got = source_mix.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and {r.doc_id for r in got} == {r[0] for r in ROWS}
    assert all((r.size, r.taken) == (0, 0) for r in got if r.doc_id in (2, 3, 4))
    assert {r.size for r in got if r.doc_id == 5} == {40_000} and {r.size for r in got if r.doc_id == 7} == {1}
    assert all(r.taken <= 3 * r.size for r in got)
    assert len({r.copies for r in got if r.doc_id == 1}) == 1
    assert source_mix.mix_sources(docs.limit(0)).count() == 0
    assert {r.target for r in source_mix.mix_sources(docs.where("doc_id = 2")).collect()} == {0.0}


def plain_audit(rows, labels):
    flags, first = [], {}
    for doc, text, part in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    for doc, text, part in rows:
        text = text or ""
        w = text.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)}
        fails |= {"D": any(c in "#$%&*|" for c in text), "E": doc is not None and doc > first[text]}
        flags.append((part or "", {f for f, x in fails.items() if x}, (doc, "q") in labels, (doc, "t") in labels))
    out = []
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rest = []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                hit = [x for x in own if f in x[1] and not x[1] & before]
                shapley[f] += len(hit)
                kept = sum(not x[1] & set(order[: step + 1]) for x in own)
                redundant, alone = sum(f in x[1] for x in own) - len(hit), sum(x[1] == {f} for x in own)
                rest.append((part, "".join(order), step + 1, kept, len(hit), redundant, alone, sum(x[2] for x in hit), sum(x[3] for x in hit), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in rest]
    return sorted(out)


@pytest.mark.parametrize("rows_each", [3, 1 << 18])
def test_audit_equals_brute_force(spark, docs, monkeypatch, rows_each):
    monkeypatch.setattr(filter_audit.segments, "__defaults__", (rows_each,))
    rng = random.Random(1)
    rows = [(r[0], r[1], r[3]) for r in ROWS]
    for i in range(150):
        words = [rng.choice(["a", "b", "Cd", "e$"] if rng.random() < 0.1 else [f"w{k}" for k in range(rng.randint(1, 300))]) for _ in range(rng.randint(0, 400))]
        rows.append((rng.randint(0, 200), rng.choice(rows)[1] if rng.random() < 0.3 else " ".join(words), rng.choice(["en", "de", None])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("digest", F.lit("x")).withColumn("part", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flags = filter_audit.failures(df, marks)
    got = filter_audit.interactions(filter_audit.subset_sums(filter_audit.postings(flags)))
    known = {(d, "q") for d, q, _ in labels if q == 1 and d is not None} | {(d, "t") for d, _, t in labels if t == 1 and d is not None}
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, known)


def test_audit_of_an_empty_table(docs):
    flags = filter_audit.failures(docs.limit(0))
    assert filter_audit.interactions(filter_audit.subset_sums(filter_audit.postings(flags))).count() == 0


def test_postings_hold_the_ids(spark):
    flags = spark.range(1000).selectExpr("id", "CAST(id % 3 AS string) part", "CAST(id % 4 AS int) fails", "id % 2 = 0 good", "false toxic")
    lists = filter_audit.postings(flags, ("f", "g")).collect()
    for r in lists:
        ids = np.frombuffer(r.ids, "<i8")
        assert (ids[0], ids[-1], len(ids)) == (r.first, r.last, r.n) and all(np.diff(ids) > 0)
        assert all(ids[np.frombuffer(r.g, "<u4")] % 4 >= 2) and all(ids % 3 == int(r.part))
    assert sum(r.n for r in lists) == 1000


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 40)), st.sets(st.integers(0, 40)))
def test_merges_of_sorted_lists(a, b):
    x, y = (np.array(sorted(s), "<u4") for s in (a, b))
    assert filter_audit.union(x, y).tolist() == sorted(a | b)
    assert filter_audit.difference(x, y).tolist() == sorted(a - b)
    assert filter_audit.shared(x, y) == len(a & b)


def test_mix_is_native(spark):
    plan = Q.op12_source_mix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


