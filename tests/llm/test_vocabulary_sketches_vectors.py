"""Spelling variants, bottom-k sketches and whitening against plain versions, on small tables with the awkward cases in them."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from milaan.llm import op11_spelling, op12_bottomk, op13_whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling ---


def plain_vocabulary(docs):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_apart(w, v))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    rows = set()
    for w, (form, n, near, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, near, m))
    return rows


def shown(frame):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_of_documents(spark):
    r = random.Random(3)
    some = ["".join(r.choice("abcéÿ") for _ in range(r.randint(5, 9))) for _ in range(400)]
    docs = [(i, " ".join(r.choice(some[: 40 + i]).upper() if r.random() < 0.1 else r.choice(some[: 40 + i]) for _ in range(300))) for i in range(60)]
    docs += [(None, "abcabc " * 40), (None, None), (3, ""), (4, "× ÷ 12345 !!"), (5, "abcabca " * 7), (5, "abcabca " * 7), (7, ("a" * 70_000 + " ") * 5), (8, ("a" * 70_001 + " ") * 30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = op11_spelling.variants(op11_spelling.vocabulary(frame.withColumnsRenamed({}).selectExpr("*", "1 AS word", "2 AS n", "3 AS run", "4 AS id")))
    rows = shown(got)
    assert rows == plain_variants(plain_vocabulary(docs)) and len(rows) == got.count() > 100
    assert any(f for _, f, *_ in rows) and any(len(w) > 60_000 and f for w, f, *_ in rows)


def test_hot_parts_are_cut_into_tiles(spark):
    r = random.Random(5)
    words = {"prefix" + "".join(r.choice("abc") for _ in range(r.randint(3, 7))): r.randint(5, 900) for _ in range(500)}
    words |= {"".join(r.choice("abc") for _ in range(r.randint(3, 7))) + "suffix": r.randint(5, 900) for _ in range(500)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(7)
    assert shown(op11_spelling.variants(frame, limit=30)) == plain_variants(words)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=6, max_size=9), min_size=1, max_size=30))
def test_index_finds_what_lies_one_edit_behind_the_half(words):
    names = sorted(words)
    who, word = op11_spelling.Index.of(names).one_error(names, np.array([len(w) // 2 for w in names]))
    want = {(a, b) for a in names for b in names if one_apart(a, b) and b.startswith(a[: len(a) // 2])}
    got = [(names[i], names[j]) for i, j in zip(who, word, strict=True)]
    assert set(got) == want and len(got) == len(want)


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "y")], "word string, form string")
    got = {r["word"]: r["root"] for r in op11_spelling.roots(links).collect()}
    assert got == {f"w{i}": "w21" for i in range(21)} | {"x": "y"}


def test_no_words(spark):
    none = spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")
    assert op11_spelling.variants(op11_spelling.vocabulary(none)).count() == 0
    assert op11_spelling.variants(op11_spelling.vocabulary(none.limit(0))).count() == 0


# --- sketches ---


def hashes(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x]
    out = set()
    for i in range(max(len(w) - 4, min(1, len(w)))):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def least(s):
    return sorted(s)[:128]


def likeness(a, b):
    u = least(set(a) | set(b))
    return len(set(a) & set(b) & set(u)) / len(u) if u else 1.0


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("taremosulé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    return [
        (0, prose(300)), (5, None), (3, ""), (9, "!!! ???"), (12, "two words"), (13, "Two, WORDS!"), (-4, prose(40)), (7, prose(30_000)), (8, "x" * 200_000),
        (20, "𝔘𝔫𝔦 𝄞 " * 30), (21, prose(2000)), (None, prose(50)), (None, "null id"), (22, "same same " * 90), (23, "odd"),
    ]


def test_fingerprints_equal_a_plain_version(spark, texts, monkeypatch):
    frame = spark.createDataFrame([(*t, 1, 2, 3) for t in texts], "doc_id long, text string, sketch int, n_chars int, fingerprint int")
    monkeypatch.setattr(op12_bottomk, "table", lambda *_: frame.repartition(4))
    got = op12_bottomk.op12_bottomk(spark, "").collect()
    order = sorted([t for t in texts if t[0] is not None], key=lambda t: -t[0])
    nulls = [t for t in texts if t[0] is None]
    assert len(got) == len(texts)

    def want(docs):
        out = []
        for i, (doc, text) in enumerate(docs):
            text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            a, b, c = (least(hashes(t)) for t in (text, edited, after))
            print_ = lambda s: "".join("%016X" % (h & (1 << 64) - 1) for h in s)
            out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_(a), print_(b), likeness(a, b), likeness(a, c)))
        return sorted(out, key=repr)

    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    rows = sorted((tuple(r[c] for c in columns) for r in got), key=repr)
    assert rows in (want([*order, *nulls]), want([*order, *nulls[::-1]]))  # two texts without id: in order of a hash


def test_repeated_rows_come_back_and_empty_tables_stay_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words under one id"), (None, None), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = op12_bottomk.fingerprints(frame).select("doc_id", "text", "copies").collect()
    assert sorted((r["doc_id"] is None, r["text"], r["copies"]) for r in got) == [(False, "a b c d e f", 2), (False, "other words under one id", 1), (True, "", 2)]
    assert op12_bottomk.fingerprints(frame.limit(0)).count() == 0


def test_neighbours_across_many_ranges(spark):
    ids = random.Random(2).sample(range(-(10**6), 10**6), 3000)
    frame = spark.createDataFrame([(i, "x" * (abs(i) % 9)) for i in ids], "doc_id long, text string").repartition(6)
    got = {r["__before__id"]: r["__id"] for r in op12_bottomk.neighbours(frame).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_sketches_of_parts_merge_and_estimate(spark):
    r = random.Random(4)
    w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(9000)]
    parts = [(1, " ".join(w[i : i + 904])) for i in range(0, 9000, 900)] + [(2, "few words"), (3, ""), (None, "nothing more")]
    one = op12_bottomk.with_sketch(spark.createDataFrame(parts, "g int, text string"), "text", "sketch")
    got = {x["g"]: x["sketch"] for x in op12_bottomk.merged(one, ["g"]).collect()}
    whole = hashes(" ".join(w))
    assert got[1] == least(whole) and got[3] == [] and len(got[2]) == len(got[None]) == 1
    half = least(hashes(" ".join(w[:4500])))
    from pyspark.sql import functions as F

    both = spark.createDataFrame([(got[1], half)], "a array<long>, b array<long>")
    n, j, c = both.select(op12_bottomk.distinct_shingles(F.col("a")), op12_bottomk.resemblance(F.col("a"), F.col("b")), op12_bottomk.containment(F.col("b"), F.col("a"))).first()
    assert n == pytest.approx(len(whole), rel=0.3) and j == pytest.approx(0.5, abs=0.15) and c == pytest.approx(1, abs=0.3)


# --- whitening ---


def plain_whitening(vectors, k=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    z = u - u.mean(0)
    values, turn = np.linalg.eigh(z.T @ z / len(u))
    return x, u, values[::-1][:k], turn[:, ::-1][:, :k], values.sum()


@pytest.mark.parametrize("d, n", [(3, 200), (40, 300), (120, 2000)])
def test_whitening_equals_an_eigendecomposition(spark, d, n, monkeypatch):
    r = np.random.default_rng(d)
    v = r.standard_normal((n, d)) * np.linspace(3, 0.5, d)
    v[n // 2 :] = v[: n - n // 2]  # copies
    rows = [(i, [float(a) for a in x], "own", 1) for i, x in enumerate(v)]
    odd = [(n, None), (n + 1, [None] * d), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] + [0.0] * (d - 1)), (n + 4, [1.0]), (n + 5, []), (n + 6, [1e300] * d)]
    frame = spark.createDataFrame(rows + [(i, x, "own", 1) for i, x in odd], "vec_id long, embedding array<double>, n string, whitened int").repartition(5)
    monkeypatch.setattr(op13_whitening, "table", lambda *_: frame)
    got = op13_whitening.op13_whitening(spark, "").collect()
    x, u, values, turn, trace = plain_whitening(v)
    k = len(values)
    assert len(got) == n * k and {r["component"] for r in got} == set(range(1, k + 1)) and {r["n"] for r in got} == {len(u)}
    white = np.zeros((n, k))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9) and r["identity_error"] < 1e-9
    want = (x - u.mean(0)) @ turn / np.sqrt(values)
    assert np.abs(white - want * np.sign((white * want).sum(0))).max() < 1e-7
    s = u.sum(0)
    exact = {i: sum((len(u) * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True)) for i in range(0, n, 17)}
    assert all(r["deviation"] == exact[r["vec_id"]] for r in got if r["vec_id"] in exact)


def test_flat_and_clustered_spectra_are_certified():
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.standard_normal((300, 300)))
    for values in (np.ones(300), np.r_[np.ones(200) + 1e-9 * r.random(200), np.zeros(100)], np.geomspace(1, 1e-14, 300), np.r_[5.0, np.linspace(1.01, 1, 299)]):
        matrix = (q * values) @ q.T
        got, turn, residual = op13_whitening.leading(lambda block, m=matrix: m @ block, 300, 16)
        assert residual <= op13_whitening.CERTIFIED and np.allclose(got, np.sort(values)[::-1][:16], rtol=1e-9, atol=1e-13)
        assert np.abs(turn.T @ turn - np.eye(16)).max() < 1e-12


def test_large_deviations_stay_exact(spark):
    rows = spark.createDataFrame([(1, [float(1 << 40), 0.0]), (2, [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got, model = op13_whitening.whiten(rows)
    by = {r["id"]: int(r["deviation"]) for r in got.collect()}
    assert by == {1: (1 << 46) ** 2 + 64**2, 2: (1 << 46) ** 2 + 64**2, None: (1 << 46) ** 2 + 64**2} and model.centre.n == 2


def test_nothing_to_whiten(spark, monkeypatch):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        monkeypatch.setattr(op13_whitening, "table", lambda *_, f=frame: f)
        assert op13_whitening.op13_whitening(spark, "").count() == 0
