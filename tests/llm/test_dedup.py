import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import exact_dedup, line_dedup, near_dedup
from lumenfold.llm.common import connected_components
from tests.llm import brute
from tests.llm.conftest import edited, prose


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts", [1, 7])
def test_exact_dedup(docs, rows, keep, parts):
    got = exact_dedup.exact_dedup(docs, keep, parts).collect()
    groups = {}
    for r in rows:
        groups.setdefault(brute.fold(r[1]), []).append(r[0])
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_exact_dedup_group_over_many_partitions(spark):
    many = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'SAME text', concat('t', id)) as text")
    got = exact_dedup.exact_dedup(many, "largest", 9).where("group_size > 1").collect()
    assert len(got) == 1667 and {r.keep_id for r in got} == {4998} and {r.group_size for r in got} == {1667}


def near_want(rows, width):
    sets = [brute.shingles(r[1], width) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if brute.similar(sets[a], sets[b])]
    comp = brute.components(len(rows), links)
    ids = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            ids[c] = min(ids.get(c, r[0]), r[0])
    return sorted(repr((r[0], len(s), r[0] if not s else ids.get(c))) for r, s, c in zip(rows, sets, comp))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, rows, width):
    got = near_dedup.near_duplicates(docs, width).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == near_want(rows, width)


@pytest.mark.parametrize("region, held", [(8, 65_536), (30, 5)])
def test_near_crowded_regions(spark, monkeypatch, region, held):
    """Regions beyond the limit go deeper, and block by block: nothing is lost."""
    monkeypatch.setattr(near_dedup, "REGION", region)
    monkeypatch.setattr(near_dedup, "HELD", held)
    base = prose(9, 100)
    some = [base] + [edited(base, i) for i in range(0, 60, 2)] + [edited(edited(edited(base, i), i + 9), i + 18) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(some)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == near_want(rows, 4)


@pytest.mark.parametrize("region, held, parts, seed", [(4, 4, 16, 1), (4, 4, 1, 2), (4, 65_536, 5, 3), (1024, 4, 16, 4), (4, 4, 7, 5), (2, 3, 16, 6)])
def test_near_runs_cut_between_tasks(spark, monkeypatch, region, held, parts, seed):
    """Chains of near copies whose runs lie in several tasks and batches: every link is found."""
    monkeypatch.setattr(near_dedup, "REGION", region)
    monkeypatch.setattr(near_dedup, "HELD", held)
    r, some = random.Random(seed), []
    for k in range(10):
        base = prose(300 + 40 * seed + k, 60 + r.randrange(60))
        for _ in range(r.randrange(3, 30)):
            some.append(base)
            base = edited(base, r.randrange(60), f"E{r.randrange(100)}") if r.random() < 0.7 else edited(some[-1 - r.randrange(min(3, len(some)))], r.randrange(50), "x")
    rows = list(enumerate(some))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).select("doc_id", "n_shingles", "component_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(repr(tuple(r)) for r in got) == near_want(rows, 4)


def test_near_group_beyond_a_region(spark):
    """1,500 near copies at the default bounds over 9 tasks are one group; others stay apart."""
    base = prose(77, 200)
    some = [edited(edited(base, i % 200, f"a{i}"), (i * 7 + 3) % 200, f"b{i}") for i in range(1500)] + [prose(9000 + i, 70) for i in range(20)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 9)
        got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string"), 4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.component_id for r in sorted(got)] == [0] * 1500 + list(range(1500, 1520))


@pytest.mark.parametrize("percent", [50, 65, 90])
def test_near_other_thresholds(spark, percent):
    base = prose(19, 60)
    some = [base] + [edited(base, i) for i in range(8)] + [edited(edited(edited(base, i), i + 20), i + 40) for i in range(10)] + [prose(20 + i, 30) for i in range(5)]
    sets = [brute.shingles(t, 4) for t in some]
    comp = brute.components(len(some), [(a, b) for a in range(len(some)) for b in range(a) if brute.similar(sets[a], sets[b], percent)])
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string"), 4, percent)
    assert [r.component_id for r in sorted(got.collect())] == comp


def test_keep_one(docs, rows):
    kept = near_dedup.keep_one(docs, 5).collect()
    assert kept[0].asDict().keys() == docs.first().asDict().keys()
    ids = [r.doc_id for r in kept]
    assert ids.count(3) == 1 and not {4, 5, 6, 8} & set(ids) and {7, 9, 11, 0, 1, 2} <= set(ids)


def test_line_dedup(docs, rows):
    got = line_dedup.dedup_lines(docs).collect()
    lines = [(r[0], k, x.lower().strip(" \t\n\r\x0b\x0c")) for r in rows if r[1] is not None for k, x in enumerate(r[1].split("\n"))]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t} for _, _, t in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if lines[a][2] and lines[b][2] and brute.similar(sets[a], sets[b])]
    comp = brute.components(len(lines), links)
    best = {}
    for (i, k, t), c in zip(lines, comp):
        if t:
            best[c] = min(best.get(c, (True, 0, 0)), (i is None, i or 0, k))
    want = []
    for (i, k, t), c in zip(lines, comp):
        none, a, b = best[c] if t else (i is None, i or 0, k)
        keep = (None if none else a, b)
        want.append((i, k, (i, k) == keep, *keep))
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    decided = line_dedup.dedup_lines(docs.where("doc_id = 16"))
    assert line_dedup.rewrite(docs.where("doc_id = 16"), decided).first().text == "line a\nline b\n"


def test_line_candidates_by_the_link_shingles(spark):
    """Separators, unbroken long lines and lines of 8 and 9 characters link as brute force says."""
    r = random.Random(11)
    texts = ["-" * n for n in (4, 5, 7, 8, 63, 64, 100, 101, 300)] + ["=" * 6, "=" * 120]
    for n in (62, 99, 101, 160, 400):
        dna = "".join(r.choice("acgt") for _ in range(n))
        texts += [dna, dna[1:], dna[:-1], "g" + dna, dna[: n // 2] + "tttt" + dna[n // 2 :]]
    for _ in range(20):
        eight = "".join(r.choice("abcdefghij") for _ in range(8))
        texts += [eight, eight + "x", "y" + eight, eight[:7]]
    texts = sorted(set(texts))
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} or {t} for t in texts]
    comp = brute.components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if brute.similar(sets[a], sets[b])])
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert [x.keep_doc_id for x in sorted(got)] == comp


@pytest.mark.parametrize("union, percent, recall", [(10, 80, 0.99), (20, 80, 0.99), (40, 80, 0.99), (100, 80, 0.99), (300, 80, 0.99), (100, 85, 0.998), (200, 90, 0.999)])
def test_line_recall(union, percent, recall):
    """The share of 20,000 pairs of sets of shingles of a similarity that have a band in common and pass the sieve."""
    r, pairs = np.random.default_rng(union + percent), 20_000
    shared = union * percent // 100
    own = (union - shared) // 2
    h = r.integers(0, 2**64, (pairs, union), dtype=np.uint64)
    sides = [h[:, : shared + own], np.concatenate([h[:, :shared], h[:, shared + own :]], axis=1)]
    made = []
    for side in sides:
        owner = np.repeat(np.arange(pairs), side.shape[1])
        values, there, bins = line_dedup.minima(side.ravel(), owner, pairs)
        keys, lines = line_dedup.keys_of(values, there, np.full(pairs, union <= line_dedup.SHORT))
        made.append((set(zip(keys.tolist(), lines.tolist())), line_dedup.sign_of(values, bins, np.full(pairs, side.shape[1]))))
    band = {line for _, line in made[0][0] & made[1][0]}
    sieved = [line_dedup.passes(*([c[k : k + 1] for c in sign] for _, sign in made), 80)[0, 0] for k in range(pairs)]
    assert all(sieved) and len(band) / pairs >= recall, len(band) / pairs


@pytest.mark.parametrize("size", [12, 40, 110, 1000])
def test_unlike_lines_share_few_bands(size):
    """Of pairs of similarity 0.1 fewer than one in a thousand has a band; the sieve lets fewer than one in a hundred of all pass."""
    r, pairs = np.random.default_rng(4), 2000
    both = 2 * size // 11
    h = r.integers(0, 2**64, (pairs, 2 * size - both), dtype=np.uint64)
    made = []
    for side in (h[:, :size], h[:, size - both :]):
        values, there, bins = line_dedup.minima(side.ravel(), np.repeat(np.arange(pairs), side.shape[1]), pairs)
        made.append((set(zip(*map(np.ndarray.tolist, line_dedup.keys_of(values, there, np.zeros(pairs, bool))))), line_dedup.sign_of(values, bins, np.full(pairs, size))))
    assert len({line for _, line in made[0][0] & made[1][0]}) <= 4
    assert line_dedup.passes(*(sign for _, sign in made), 80).mean() < 0.01


@pytest.mark.parametrize("chars, names", [(1, 1), (50, 3), (500_000, 200_000)])
def test_lines_signed_in_slices(spark, docs, monkeypatch, chars, names):
    """However lines are sliced, and if they are signed over and over, the answer is one."""
    want = sorted(map(repr, map(tuple, line_dedup.dedup_lines(docs).collect())))
    monkeypatch.setattr(line_dedup, "CHARS", chars)
    monkeypatch.setattr(line_dedup, "NAMES", names)
    assert sorted(map(repr, map(tuple, line_dedup.dedup_lines(docs.repartition(5)).collect()))) == want


@pytest.mark.parametrize("pack, ranges", [(1 << 20, 16), (500, 1), (0, 40)])
def test_band_keys_packed(spark, monkeypatch, pack, ranges):
    """Keys cross the shuffle as arrays, a row for each range and not for each key, and none that lines share is lost."""
    monkeypatch.setattr(line_dedup, "PACK", pack)
    monkeypatch.setattr(line_dedup, "RANGES", ranges)
    monkeypatch.setattr(line_dedup, "CHARS", 2000)
    words = "river stone cloud amber field night glass paper green wheel".split()
    texts = [" ".join(words[(i * 7 + k * (1 + i % 3)) % 10] for k in range(12)) + (f" {i}" if i % 4 else "") for i in range(150)] + ["ab", "x"]
    lines = [(k * 1000 - 70_000, k, t) for k, t in enumerate(texts)]
    h, owner = line_dedup.hashes(texts)
    values, there, _ = line_dedup.minima(h, owner, len(texts))
    keys, at = line_dedup.keys_of(values, there, np.bincount(owner) <= line_dedup.SHORT)
    found = {}
    for key, k in zip(keys.tolist(), at.tolist()):
        found.setdefault(key, set()).add(lines[k][0])
    want = {(key, line, min(x)) for key, x in found.items() if len(x) > 1 for line in x}
    df = spark.createDataFrame(lines + lines, "line bigint, second bigint, norm string").repartition(3)
    got = [tuple(r) for r in line_dedup.shared_keys(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    if pack > len(keys):
        packed = df.mapInArrow(line_dedup._packer(ranges * 4), line_dedup.PACKED).agg(F.count("*"), F.sum(F.length("keys"))).first()
        assert packed[0] <= 3 * ranges * 4 < packed[1] // 8


@pytest.mark.parametrize("forest", [False, True])
@pytest.mark.parametrize("step", [10_000, 77, 5])
def test_small_buckets_compared_together(monkeypatch, forest, step):
    """However batches cut them, small tasks compared together give what each gives by itself, in few turns of the sieve."""
    r, rows, turns = np.random.default_rng(5), [], []
    for key, n in enumerate([*r.integers(2, 9, 400), 150, 3, 2, 90, 2, 2]):
        comp, line, sign = r.integers(0, 6, n), r.choice(10**6, n, replace=False), np.tile(r.integers(-(2**63), 2**63, 7), (n, 1))
        sign[:, -1] = r.integers(60, 80, n)
        flip = r.random(n) < 0.5
        sign[flip, :6] ^= r.integers(-(2**63), 2**63, (flip.sum(), 6))
        sides = [(0, x) for x in range(n) if comp[x] != comp[0]]
        rows += [(key, 0, side, int(line[x]), int(comp[x]), *map(int, sign[x])) for side, x in (sides and sides + [(1, x) for x in range(n)])]
    kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["key", "part", "side", "line", "comp", *line_dedup.SIGN])
    run = lambda: [p for b in line_dedup._comparer(80, forest)(batch.slice(k, step) for k in range(0, len(batch), step)) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())]
    real = line_dedup._sieve
    monkeypatch.setattr(line_dedup, "_sieve", lambda *x: turns.append(1) or real(*x))
    got, few = run(), len(turns)
    monkeypatch.setattr(line_dedup, "FEW", -1)
    want = run()
    assert len(got) == len(want) > 300 and (forest or set(got) == set(want))
    assert step < 10_000 or few * 20 < len(turns) - few


def test_rewrite_of_null_and_repeated_ids(spark, empty):
    """Each row keeps its own kept lines, whatever its doc_id; blank lines stay."""
    rows = [(None, "only here\nshared line of all\n"), (1, "shared line of all\nmine and mine alone"), (1, "another row of one\nmine and mine alone"), (2, "shared line of all"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = line_dedup.rewrite(docs, line_dedup.dedup_lines(docs)).collect()
    want = [(None, "only here\n"), (1, "shared line of all\nmine and mine alone"), (1, "another row of one\nmine and mine alone"), (2, ""), (3, ""), (4, "")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert line_dedup.rewrite(empty, line_dedup.dedup_lines(empty)).count() == 0


def test_line_sets_met_in_compiled_code(spark):
    """Pairs are confirmed as brute force says, and no plan meets or sorts out their sets inside a lambda, which Spark doesn't compile."""
    base = prose(31, 12)
    norms = [base, edited(base, 3), edited(edited(base, 3), 9), base[:20], "abcd", "abc", "\U0001f600" + base, "aaaaaaa", "aaaaaaaaaa"]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} or {t} for t in norms]
    texts = spark.createDataFrame([(k, k + 100, t) for k, t in enumerate(norms)], "line bigint, id bigint, norm string")
    pairs = spark.createDataFrame([(a, b) for b in range(len(norms)) for a in range(b)], "a bigint, b bigint")
    got = line_dedup._verified(pairs, texts, 80)
    assert sorted(map(tuple, got.collect())) == [(a + 100, b + 100) for a in range(len(norms)) for b in range(a + 1, len(norms)) if brute.similar(sets[a], sets[b])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    lambdas = [plan[k:] for k in range(len(plan)) if plan.startswith("lambdafunction(", k)]
    for x in lambdas:
        depth, end = 1, len("lambdafunction(")
        while depth:
            depth += {"(": 1, ")": -1}.get(x[end], 0)
            end += 1
        assert "array_intersect" not in x[:end] and "array_distinct" not in x[:end]
    assert "array_intersect" in plan


def test_line_names_of_128_bits(spark, docs, monkeypatch):
    """Lines that share 64 bits of their name are lines of their own."""
    real = line_dedup.lines_of
    want = sorted(map(repr, map(tuple, line_dedup.dedup_lines(docs).collect())))
    monkeypatch.setattr(line_dedup, "lines_of", lambda d: real(d).withColumn("line", F.when(F.col("line").isNotNull(), F.pmod("line", F.lit(3)))))
    assert sorted(map(repr, map(tuple, line_dedup.dedup_lines(docs).collect()))) == want


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (5, 5)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


@pytest.mark.parametrize("block, cells, forests", [(2048, 1 << 21, 2), (4, 64, 2), (3, 6, 0), (4, 8, 1)])
def test_line_buckets_in_blocks(spark, monkeypatch, block, cells, forests):
    """Large groups whose members drift apart, whole and in small blocks: what brute force says."""
    monkeypatch.setattr(line_dedup, "FORESTS", forests)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "CELLS", cells)
    r, texts = random.Random(8), []
    for base in (prose(70, 40), prose(71, 40)):
        for _ in range(40):
            w = base.split(" ")
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = r.choice(["zz", "yy", "xx"])
            texts.append(" ".join(w))
    texts = sorted(set(texts))
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    comp = brute.components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if brute.similar(sets[a], sets[b])])
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert [x.keep_doc_id for x in sorted(got)] == comp
