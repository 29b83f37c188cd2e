import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import SCHEMA, edited, prose


def test_stages_on_edge_rows(spark, docs, tmp_path_factory, empty):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "nothing like that here at all in any of the texts")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    for start in (docs, empty):
        at = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = stage(spark, at, d)
            if k < 4:
                assert at.columns == start.columns
        assert at.columns == [*start.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        at.count()


def test_last_stage_carries_rows(spark, docs, rows):
    """All columns with shard and slot, a clashing one renamed, slots without gaps."""
    start = docs.withColumnRenamed("comp", "shard").withColumnRenamed("h", "seq")
    got = corpus_pipeline.assign_shards(spark, start, "")
    assert got.columns == [c if c != "shard" else "shard_" for c in start.columns] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    out = got.collect()
    assert sorted(map(repr, (tuple(r)[: len(start.columns)] for r in out))) == sorted(map(repr, map(tuple, rows)))
    for shard in range(8):
        mine = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in out if r.shard == shard)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert all(r.shard == brute.jump(r.doc_id or 0, 8) for r in out)


def test_language_stage_keeps_all_with_letters(spark, docs):
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in got.collect()} == {0, 1, 2, 14}


def test_language_stage_rejects_by_score_and_language(spark, monkeypatch):
    en, de = "the cat and the dog were in the house", "der hund und die katze waren in dem haus"
    rows = [(i, (en, de)[i % 2], ("en", "de")[i % 2]) for i in range(40)] + [(50, "qqq", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("en",))
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} - {50} == set(range(0, 40, 2))
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", None)
    monkeypatch.setattr(corpus_pipeline, "MIN_SCORE", 0.6)
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == set(range(40))


def test_language_stage_without_labels(spark, docs):
    """Nothing to learn from, or a language that is called und: only texts without a letter go."""
    for lang in ("cast(null as string)", "'und'"):
        start = docs.selectExpr("doc_id", "text", f"{lang} as lang")
        got = corpus_pipeline.identify_language(spark, start, "")
        assert got.columns == start.columns
        assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in got.collect()} == {0, 1, 2, 14}


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.select("shard").distinct().count() == 8


def test_near_stage_against_brute_force(spark):
    """One row of each group, whatever the other columns of rows with one doc_id hold; rows without words all stay."""
    base, other = prose(31, 80), prose(32, 80)
    row = lambda i, t, lang, source: (i, t, lang, source, len(t or ""), "x", 1, 2, 3, "l")
    rows = [row(i, t, lang, s) for i, t in ((1, base), (None, other), (2, edited(base, 40))) for lang, s in (("en", "s1"), ("en", "s2"), ("en", None), (None, "en"), ("en", "s1"))]
    rows += [row(3, prose(33, 80), "en", "s1"), row(4, " ", "en", "s1"), row(4, " ", "en", "s1"), row(5, None, None, "s1"), row(5, None, None, "s1"), row(None, "", "en", "s2")]
    sets = [brute.shingles(r[1], 5) for r in rows]
    comp = brute.components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if brute.similar(sets[a], sets[b])])
    groups = {}
    for k, c in enumerate(comp):
        groups.setdefault(c, []).append(k)
    want = [min((rows[k][0] is None, rows[k][0] or 0) for k in g) for g in groups.values()]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(want)
    assert all(tuple(r) in rows for r in got)
    again = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows[::-1], SCHEMA).repartition(2), "").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_whole_pipeline_against_brute_force(spark, tmp_path_factory):
    """Rows of one language to keep; of what is left near copies, benchmark passages, the mix and shards by hand."""
    d = str(tmp_path_factory.mktemp("sf"))
    item = prose(90, 30)
    row = lambda i, t, s: (i, t, "en", s, len(t or ""), "x", 1, 2, 3, "l")
    rows = [row(i, prose(100 + i, 50), f"s{i % 2}") for i in range(12)]
    rows += [row(20 + i, edited(rows[i][1], 30), "s0") for i in range(3)] + [row(30, prose(130, 20) + " " + item[:200], "s1"), row(31, item, "s0"), row(40, "12 34", "s0"), row(41, None, "s0"), row(2, rows[2][1], "s0")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    sets = [brute.shingles(r[1], 5) for r in left]
    comp = brute.components(len(left), [(a, b) for a in range(len(left)) for b in range(a) if brute.similar(sets[a], sets[b])])
    best = {c: min(left[k][0] for k in range(len(left)) if comp[k] == c) for c in comp}
    ids = sorted(i for i in best.values() if not brute.leaks(next(r[1] for r in rows if r[0] == i), [(1, item)])[1])
    assert ids == list(range(12))
    out = corpus_pipeline.run(spark, d).collect()
    size = {i: len(rows[i][1].split()) for i in ids}
    for source in (0, 1):
        mine = [r for r in out if r.doc_id % 2 == source]
        assert {r.doc_id for r in mine} <= set(ids)
        taken, whole = sum(size[r.doc_id] for r in mine), sum(size[i] for i in ids if i % 2 == source)
        target = whole * 2.0 if source == 0 else 1.5 * sum(size.values()) - 2.0 * sum(size[i] for i in ids if i % 2 == 0)
        assert abs(taken - target) <= 50 / 2 + 1e-6 and all(sum(r.doc_id == i for r in mine) <= 2 for i in ids)
    assert all(r.shard == brute.jump(r.doc_id, 8) and r.text == rows[r.doc_id][1] and r.source == rows[r.doc_id][3] for r in out)
