import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import divergence, embedding_dedup, whitening
from tests.llm import brute
from tests.llm.conftest import prose

VECTORS = "vec_id bigint, embedding array<float>, label int, name string, x int, cid int, d string"


def vectors(spark, rows, kind="float"):
    extra = [(i, v, i or 0, "n", 1, 2, "d") for i, v in rows]
    return spark.createDataFrame(extra, VECTORS.replace("float", kind)).repartition(3)


@pytest.fixture(scope="module")
def embeddings():
    """Chains and crowds of near copies, equal vectors, multiples, and all that can't link."""
    r = np.random.default_rng(3)
    out = [r.standard_normal(40) for _ in range(60)]
    for k in range(6):  # a chain: neighbours alike, ends not
        out.append(out[-1] + 0.25 * r.standard_normal(40) if k else 3 * out[0])
    out += [out[5] + 0.12 * r.standard_normal(40) for _ in range(50)]
    out += [out[7]] * 30 + [out[7] * 2.0] * 3
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]
    rows += [(200, None), (201, [0.0] * 40), (202, [None, *rows[3][1][1:]]), (203, [math.nan, *rows[3][1][1:]]), (204, [math.inf, *rows[3][1][1:]]), (205, []), (None, rows[9][1]), (9, rows[9][1]), (206, [-0.0] * 40), (207, rows[3][1][:39])]
    return rows


def links_of(rows, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    out = []
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                    out.append((a, b))
    return out


@pytest.mark.parametrize("cosine", [0.95, 0.8])
@pytest.mark.parametrize("tile, part, step", [(32_768, 512, 1024), (40, 7, 16), (16, 3, 5)])
def test_near_vectors(spark, embeddings, monkeypatch, cosine, tile, part, step):
    """Whole tiles, and many small ones that cut every crowd: what brute force says."""
    real = embedding_dedup.tiles_of
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    if tile < 32_768:
        monkeypatch.setattr(embedding_dedup, "tiles_of", lambda p: real(p).withColumn("tile", embedding_dedup.F.col("part") * 100 + embedding_dedup.F.floor(embedding_dedup.F.col("seq") * part / tile)))
    monkeypatch.setattr(embedding_dedup, "PART", part)
    monkeypatch.setattr(embedding_dedup, "STEP", step)
    got = embedding_dedup.near_vectors(vectors(spark, embeddings), cosine).collect()
    links = links_of(embeddings, cosine)
    comp = brute.components(len(embeddings), links)
    count = Counter(x for pair in links for x in pair)
    least = {}
    for (i, _), c in zip(embeddings, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [(i, count[k], least.get(c)) for k, ((i, _), c) in enumerate(zip(embeddings, comp))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert max(count.values()) >= 50


def test_near_vectors_of_doubles_and_none(spark, embeddings):
    got = embedding_dedup.near_vectors(vectors(spark, embeddings, "double"), 0.95)
    assert {r.n_links for r in got.collect()} == {r.n_links for r in embedding_dedup.near_vectors(vectors(spark, embeddings), 0.95).collect()}
    assert embedding_dedup.near_vectors(vectors(spark, [])).count() == 0
    alone = embedding_dedup.near_vectors(vectors(spark, [(1, None), (None, [0.0])])).collect()
    assert sorted(map(repr, map(tuple, alone))) == ["(1, 0, 1)", "(None, 0, None)"]


def test_blocks_and_rotation():
    for d in (1, 15, 16, 17, 40, 64, 100):
        cuts = embedding_dedup.blocks(d)
        assert cuts[0][0] == 0 and cuts[-1][1] == d and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and max(e - s for s, e in cuts) <= 16
        assert np.allclose(embedding_dedup.rotation(d) @ embedding_dedup.rotation(d).T, np.eye(d))


def whitened_by_hand(rows, components):
    keep = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) <= 2**55 for x in v)]
    out = []
    for d in {len(v) for _, v in keep} - {0}:
        some = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in keep if len(v) == d]
        fit = sorted({tuple(x) for _, x in some})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        exact = np.array([[n * x - s for x, s in zip(v, sums)] for v in fit], dtype=np.float64) / n
        cov = exact.T @ exact / n
        values, vecs = np.linalg.eigh(cov)
        values, vecs = values[::-1], vecs[:, ::-1]
        k = min(components, sum(values > 1e-12 * max(values[0], 0)) if values[0] > 0 else 0)
        for i, x in some:
            away = [n * a - s for a, s in zip(x, sums)]
            w = (np.array(away, dtype=np.float64) / n) @ vecs[:, :k] / np.sqrt(values[:k])
            out += [(i, c + 1, n, sum(a * a for a in away), w[c], values[c] / values.sum()) for c in range(k)]
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_whitening(spark, parts):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(r.standard_normal((300, 20)) * np.linspace(0.3, 3, 20))]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(None, rows[1][1]), (2, rows[2][1])]
    rows += [(2000, None), (2001, [None] * 20), (2002, [math.nan] * 20), (2003, [math.inf] * 20), (2004, [1e30] * 20), (2005, [])]
    got = whitening.whiten(vectors(spark, rows).repartition(parts), 16).collect()
    want = whitened_by_hand(rows, 16)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    sign = {c: np.sign(g[4] * w[4]) for g, w in zip(got, want) for c in [g[1]] if abs(w[4]) > 0.1}
    assert all(abs(g[4] * sign[g[1]] - w[4]) < 1e-9 and abs(g[5] - w[5]) < 1e-12 for g, w in zip(got, want))
    assert {g[6] for g in got} == {got[0][6]} and got[0][6] < 1e-9


def test_whitening_cases(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).count() == 0
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)] + [(9, [4.0]), (10, [6.0])])).collect()
    assert sorted((x.vec_id, x.component, x.n) for x in flat) == [(i, 1, 5) for i in range(5)] + [(9, 1, 2), (10, 1, 2)]
    far = whitening.whiten(vectors(spark, [(1, [2.0**50]), (2, [-(2.0**50)]), (3, [0.0])], "double")).collect()
    assert {x.deviation for x in far} == {None, 0} and all(x.identity_error < 1e-9 for x in far)


def test_chan_merging():
    """Any split of the rows gives the moments of the whole, far from the origin too."""
    r = np.random.default_rng(1)
    x = r.integers(-50, 50, (500, 6)).astype(np.float64) + 1e6
    for cuts in ([250], [1, 2, 499], [100, 200, 300, 400]):
        found = None
        for part in np.split(x, cuts):
            s = whitening.state_of(part, [int(v) for v in part.sum(axis=0)])
            found = s if found is None else whitening.merge(found, s)
        assert found.n == 500 and found.sums == [int(v) for v in x.sum(axis=0)]
        assert np.allclose(found.scatter, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), rtol=1e-9) and np.allclose(found.mean, x.mean(axis=0), rtol=1e-14)


def audit_by_hand(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", brute.fold(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in held.items() if n >= min_docs}
        count = {s: Counter(w for d in mine if d[1] == s for w in d[2] if w in kept) for s in {d[1] for d in mine}}
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        for s in count:
            pairs = [(-sum((share(count[s], w) - share(count[o], w)) ** 2 // share(count[o], w) for w in kept), o) for o in count if o != s]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())))]
            more = [(-((share(count[s], w) - share(whole, w)) ** 2 // share(whole, w)), w) for w in count[s] if share(count[s], w) > share(whole, w)]
            out += [(lang, s, "term", w, -v, k + 1) for k, (v, w) in enumerate(sorted(more, key=lambda x: (x[0], x[1].encode()))[:top])]
    return sorted(out)


@pytest.mark.parametrize("block, chunk, segment, held", [(32, 1024, 16, 300_000), (2, 8, 2, 40), (1, 3, 1, 5)])
def test_audit(spark, docs, rows, monkeypatch, block, chunk, segment, held):
    """One task, and many block pairs, segments and chunks: the same whole numbers."""
    for name, v in (("BLOCK", block), ("CHUNK", chunk), ("SEGMENT", segment), ("HELD", held)):
        monkeypatch.setattr(divergence, name, v)
    got = divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == audit_by_hand([(r[1], r[2], r[3]) for r in rows])
    r = random.Random(4)
    more = [(i, prose(r.randrange(40), r.randrange(1, 60)) + " Zürich ÉCOLE İ", r.choice(["a", None]), r.choice(["s", "t", "u", "v", "ß", "", None])) for i in range(120)]
    more += [(500, "only here", "q", "one"), (501, None, "q", "two"), (502, "", "q", "three")]
    made = spark.createDataFrame(more, "doc_id int, text string, lang string, source string").repartition(4)
    got = divergence.audit(made, top=7).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == audit_by_hand([x[1:] for x in more], top=7)


def test_audit_of_long_texts_and_none(spark, empty, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 64)
    some = [(prose(i, 200 + i), "en", "ab"[i % 2]) for i in range(8)] + [("x" * 500 + " y", "en", "a")] * 3
    got = divergence.audit(spark.createDataFrame(some, "text string, lang string, source string")).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == audit_by_hand(some)
    assert divergence.audit(empty).count() == 0


def test_shares_are_exact(spark):
    """Long division agrees with whole numbers of any size, in SQL and in arrays."""
    r = random.Random(2)
    cases = [(0, 1), (0, 10**15), (10**15 - 1, 10**15), (8 * 10**15, 9 * 10**15)] + [(r.randrange(t), t) for t in (r.randrange(1, 9 * 10**15) for _ in range(200))]
    want = [1 + 10**9 * (c + 1) // t for c, t in cases]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c bigint, t bigint")
    assert [x.p for x in df.select("i", divergence.share(df.c, df.t).alias("p")).orderBy("i").collect()] == want
    a = np.array(cases, np.int64)
    assert divergence._shares(a[:, 0], a[:, 1]).tolist() == want
