"""Whitening, suffix order and phrases against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import UPPER

from wardlight.llm import collocations, suffix_dedup, whitening
from wardlight.llm.queries import QUERIES, table

# -- whitening -------------------------------------------------------------------------------------------------------


def entries(vectors):
    return [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]


def check_whitening(got, vectors, components=8):
    """``got``: result rows of ``vectors`` (id -> vector, all whole)."""
    ids = sorted(vectors)
    x = np.array(entries([vectors[i] for i in ids]), object)
    n, s = len(x), x.sum(0)
    u = x * n - s
    c = (u / n).astype(float)
    sizes, v = np.linalg.svd(c, full_matrices=False)[1:]
    e, v = sizes**2 / n, v.T
    side = min(components, int((sizes > 1e-11 * sizes[0]).sum()))
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(rows) == n * side
    for k in range(side):
        want = c @ v[:, k] / np.sqrt(e[k])
        mine = np.array([rows[i, k + 1]["whitened"] for i in ids])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert np.isclose(rows[ids[0], k + 1]["explained"], e[k] / e.sum(), rtol=1e-9)
    for i, d in zip(ids, (u * u).sum(1), strict=True):
        assert rows[i, 1]["deviation"] == (d if d < 2**63 else None) and rows[i, 1]["n"] == n
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_of_the_table(spark, folder):
    given = table(spark, folder, "embeddings")
    vectors = {r["vec_id"]: r["embedding"] for r in given.collect()}
    check_whitening(QUERIES["op11_whitening"](spark, folder).collect(), vectors)


def test_whitening_of_hard_rows(spark):
    """Variances twelve orders apart, a constant and a repeated dimension, copies of one row."""
    rng = np.random.default_rng(3)
    scale = np.array([1e4, 3e3, 1e2, 10, 1, 0.1, 0.02, 0.01])
    x = rng.normal(size=(400, 8)) @ np.linalg.qr(rng.normal(size=(8, 8)))[0] * scale
    x = np.hstack([x, np.full((400, 1), 7.0), x[:, :1]])
    x[200:] = x[0]
    rows = [(i, [float(c) for c in v], "other") for i, v in enumerate(x)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")).collect()
    check_whitening(got, {i: v for i, v, _ in rows})


def test_whitening_leaves_out_and_pads(spark):
    kind = "vec_id long, embedding array<float>, n string"
    rows = [(1, [1.0, 2.0, 0.5], "a"), (2, [0.25, float("nan"), 1.0], "b"), (3, None, "c"), (4, [1.0, None, 2.0], "d"), (None, [0.0, 1.0, 3.0], "e"),
            (5, [float("inf"), 0.0, 0.0], "f"), (1, [1.0, 2.0, 0.5], "g"), (6, [2.0], "h"), (7, [], "i"), (8, [-0.3, 0.9, -4.0], "j")]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 6, None: 3, 6: 3, 7: 3, 8: 3} and {r["n"] for r in got} == {6}
    padded = [[1, 2, 0.5], [0, 1, 3], [1, 2, 0.5], [2, 0, 0], [0, 0, 0], [-0.3, 0.9, -4]]
    x = np.array(entries([[np.float32(c) for c in v] for v in padded]))
    assert {r["deviation"] for r in got} == set(((6 * x - x.sum(0)) ** 2).sum(1).tolist())
    for rows in ([], [(1, [], "x")], [(1, [1.0], "x"), (2, [1.0], "x")]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).collect() == []


def test_whitening_of_huge_entries(spark):
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [5e11, -1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in got if r["vec_id"] < 2) and got[0]["identity_error"] < 1e-6
    u = np.array([[2**62, 5], [2**31 + 3, 0], [3_037_000_500, 0]])
    exact = [sum(int(v) ** 2 for v in row) for row in u]
    assert whitening.deviation_of(u).to_pylist() == [v if v < 2**63 else None for v in exact]


# -- suffix order ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", b"abcdefgh", bytes(range(0, 250, 7))])
def test_suffix_order(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(60):
        body = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 150)))
        body = body + body[rng.randrange(len(body) + 1):] * rng.randint(0, 2) + bytes([suffix_dedup.END])
        text = np.frombuffer(body, np.uint8)
        wanted = np.array([rng.random() < 0.6 for _ in body])
        wanted[-1] = False
        depth = rng.choice([8, 16, 40, 400])
        order = suffix_dedup.suffix_order(text, wanted, depth)
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        heads = [body[i:i + depth] for i in order]
        assert heads == sorted(heads)
        common = [0] + [next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))  # noqa: B905
                        for a, b in zip(heads, heads[1:])]  # noqa: B905
        assert suffix_dedup.common_prefixes(text, order, depth).tolist() == (common if len(order) else [])


def without_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        runs = int((gone & ~np.append([False], gone[:-1])).sum())
        out.append((len(r), int(gone.sum()), runs, np.frombuffer(r, np.uint8)[~gone].tobytes()))
    return out


def check_repeats(spark, texts, length, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, kept string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in
           suffix_dedup.remove_repeats(docs, length).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(((i, *w) for i, w in zip(ids, without_repeats(texts, length), strict=True)), key=key)


def test_repeats_of_the_table(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_suffix_dedup"](spark, folder).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    want = without_repeats(docs.values(), 400)
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in zip(docs, want, strict=True)}


@pytest.mark.parametrize(("section", "segments", "sorted_bytes"), [(1 << 20, 1000, 2 << 20), (700, 3, 500)])
def test_repeats_in_small_sections_and_crowded_cores(spark, monkeypatch, section, segments, sorted_bytes):
    """Shared passages in other surroundings, runs of one byte, periods, copies and wide characters."""
    monkeypatch.setattr(suffix_dedup, "SECTION", section)
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", segments)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", sorted_bytes)
    rng = random.Random(9)
    word = lambda k, of="abcde é": "".join(rng.choices(of, k=k))
    passage = word(90)
    texts = [word(rng.randint(0, 80)) + passage[rng.randint(0, 20):rng.randint(60, 90)] + word(rng.randint(0, 80)) for _ in range(60)]
    texts += ["a" * 500, "a" * 39, "a" * 40, "b" + "a" * 41 + "c", "ab" * 300, "abc" * 11, "x" * 40, "é" * 19 + "e", "é" * 90, word(3000, "ab"), word(1500, "ab")]
    long = word(2500)
    texts += [long, long, long[:1000] + "#" + long[1000:], long[700:], "", None, " ", "\0" * 60, word(2000) * 2]
    check_repeats(spark, texts, 40)


def test_repeats_of_odd_rows(spark):
    text = "".join(random.Random(2).choices("abcdefgh ", k=120))
    check_repeats(spark, [text, text, "x" + text[5:], None, "", "short"], 50, ids=[1, 1, None, None, 2, 3])
    empty = spark.createDataFrame([], "doc_id string, text string, f1 int")
    assert suffix_dedup.remove_repeats(empty).collect() == []
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.find_repeats(empty, 8)


# -- phrases ---------------------------------------------------------------------------------------------------------


def phrases(rows, top=2000, least=10, percent=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = {q for p, a in many.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= percent * c[q]}
        best = []
        for p, a in many.items():
            if p not in held:
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def check_phrases(spark, rows, **by):
    docs = spark.createDataFrame([(i, lang, text, 0) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, a int")
    assert sorted(tuple(r) for r in collocations.mine(docs, **by).collect()) == phrases(rows, **by)


def test_phrases_of_the_table(spark, folder):
    rows = [(r["lang"], r["text"]) for r in table(spark, folder, "documents").select("lang", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_phrases"](spark, folder).collect())
    assert got == phrases(rows) and len(got) > 100


@pytest.mark.parametrize(("top", "percent"), [(3, 50), (10, 50), (40, 90), (7, 10)])
def test_phrases_need_several_waves(spark, top, percent):
    """Few places, so that the frontier is grown more than once; many ties, since words are drawn alike."""
    rng = random.Random(top)
    rows = []
    for i in range(120):
        words = [rng.choice("the of a to in".split()) if rng.random() < 0.5 else f"w{rng.randint(0, 25)}" for _ in range(60)]
        for _ in range(4):
            words[rng.randrange(60):rng.randrange(60)] = rng.choice(["new york city", "Old Town", "w1 w2 w3", "of the of", "a a a a"]).split()
        rows.append((rng.choice(["en", "en", "de", None]), " ".join(words)))
    check_phrases(spark, rows, top=top, least=4, percent=percent)


def test_phrases_of_sections(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SECTION_WORDS", 7)
    rng = random.Random(4)
    check_phrases(spark, [("x", " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 90)))) for _ in range(15)], least=2)


def test_phrases_of_odd_rows(spark):
    odd = [("en", None), (None, "a b"), ("und", "A\tB"), (None, "a  b, a b. a\nb"), ("en", ""), ("en", "!?"), ("fr", "é É é É\x0bé É"), ("", "p q p q"), ("fr", "É é"),
           ("long", "m n " * 30_000), ("one", "z" * 100_000)]
    check_phrases(spark, odd * 2, least=2)
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).collect() == []
