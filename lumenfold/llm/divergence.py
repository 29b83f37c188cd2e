"""Operator 11, source divergence audit by two-dimensional group-block tiling.

Each language's sources are compared by how often they use each of its terms. One pass over
the texts counts terms by (language, source) and the documents that hold them, added up in
Python dictionaries of a bounded size before anything is shuffled. Terms in at least
min_docs documents of a language are its vocabulary.

The sources of a language are dealt to blocks of about BLOCK by a hash, its vocabulary to
chunks of about CHUNK terms, so many chunks to a segment. A source's counts in a chunk are
one packed vector. It is replicated to the tasks (block, block) of its block; a task goes over
the chunks of one segment in turn and adds up the submatrix of its pairs, in whole numbers.
Segments are summed by pair. Terms that neither source of a block pair has add the same value
each, so they are counted, not visited.

Arithmetic is exact in 64 bits while a group has fewer than 9 * 10^15 terms: shares of 10^9
come by long division in three steps of 1000.

Rules. Null text, lang and source are ''. Terms are runs of letters: A-Z lower-cased, a-z and
all code points from 128 on. Repeated rows are documents each. Very long texts are read whole,
slice by slice. Ties are ordered by item. A language without vocabulary gives its pairs the
value 0 and no terms. Other columns are ignored, whatever their names. Empty in, empty out.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, few, materialize
from lumenfold.llm.runs import runs

SCALE = 1_000_000_000
#: Sources of a block, terms of a chunk, chunks of a segment, about.
BLOCK, CHUNK, SEGMENT = 32, 1024, 16
#: Entries that a task counts before it gives them out; bytes of a text that are split at once.
HELD, SLICE = 600_000, 1 << 20

COUNTED = "lang string, source string, term binary, n bigint, docs bigint"
MEMBERS = "array<struct<source:string,total:bigint>>"
SUMS = "lang string, a string, b string, value bigint, seen bigint"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(text: bytes):
    """Lists of a text's terms, a slice of it at a time; no term is cut."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counter(batches):
    """lang, source, text -> COUNTED: sums of this task's rows; one row without a term for each group."""
    found: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0

    def given():
        for (lang, source), (count, docs) in found.items():
            terms, n = [*count, None], [*count.values(), 0]
            held_by = [*map(docs.__getitem__, count), 0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(held_by, pa.int64())], names=[c.split()[0] for c in COUNTED.split(", ")])
        found.clear()

    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for k, group in enumerate(zip(langs, sources)):
            count, docs = found[group]
            held -= len(count)
            text = texts[k].as_py().translate(_LETTERS)
            if len(text) <= SLICE:
                words = text.split()
                count.update(words)
                docs.update(set(words))
            else:
                once = set()
                for words in _words(text):
                    count.update(words)
                    once.update(words)
                docs.update(once)
            held += len(count)
            if held > HELD:
                yield from given()
                held = 0
    yield from given()


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total) without overflow: three digits of base 1000.

    count + 1 is at most total, total below 9 * 10^15."""
    whole, left = _divided(count + F.lit(1).cast("bigint"), total)
    for _ in range(3):
        digit, rest = _divided(left * 1000, total)
        whole, left = whole * 1000 + digit, rest
    return whole + 1


def _divided(a: Column, b: Column) -> tuple[Column, Column]:
    return F.call_function("div", a, b), a % b


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """share() of arrays of longs."""
    whole, left = np.divmod(counts + 1, totals)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, totals)
        whole = whole * 1000 + digit
    return whole + 1


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(text, lang, source) -> COUNTED, one row for each group and term, and for each group one whose term is null."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(_counter, COUNTED)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, min_docs: int) -> DataFrame:
    """COUNTED -> lang, source, term, n, lang_n (the language's count) and chief (one row of each term) of terms in min_docs documents of their language."""
    term = Window.partitionBy("lang", "term")
    rows = counts.where("term is not null").select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), F.min("source").over(term).alias("first"))
    return rows.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("first") == F.col("source")).alias("chief"))


def _tiles(groups: DataFrame, langs: DataFrame) -> DataFrame:
    """groups(lang, source, total, v) -> lang, i, j, segment, members: the sources of both blocks
    with their totals, a row for each task."""
    dealt = groups.join(few(langs.select("lang", "blocks", "segments")), "lang").where("v > 0")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    per = dealt.groupBy("lang", "block", "segments").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("members"))
    one = per.select("lang", "segments", F.col("block").alias("i"), F.col("members").alias("left"))
    two = per.select("lang", F.col("block").alias("j"), F.col("members").alias("right"))
    tiles = one.join(two, "lang").where("i <= j")
    return tiles.select("lang", "i", "j", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"), "left", "right")


def _packed(terms: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, block, source, segment, chunk, at, n: a source's counts in a chunk as one packed vector."""
    rows = terms.join(few(langs.select("lang", "blocks", "chunks")), "lang")
    rows = rows.select("lang", "source", "term", "n", "blocks", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"))
    place = F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    rows = rows.withColumn("place", place.cast("int"))
    packed = rows.groupBy("lang", "chunk", "source", "blocks").agg(F.collect_list(F.struct("place", "n")).alias("counts"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    return packed.select("lang", block.alias("block"), "blocks", "source", F.floor(F.col("chunk") / SEGMENT).cast("int").alias("segment"), "chunk", F.col("counts.place").alias("at"), F.col("counts.n").alias("n"))


def _tiler(batches):
    """Tasks' members and packed vectors, sorted, the members first -> SUMS of their pairs."""
    left = right = tile = None
    for chunk in runs(batches, ["lang", "i", "j", "segment", "chunk"]):
        key = tuple(chunk.column(c)[0].as_py() for c in ("lang", "i", "j", "segment"))
        if key != tile:
            if chunk.column("chunk")[0].as_py() >= 0:
                continue  # no members: the hash left the other block without a source
            if tile:
                yield from _summed(tile, left, right, value, seen)
            tile = key
            left, right = chunk.column("left")[0].as_py(), chunk.column("right")[0].as_py()
            where = {m["source"]: k for k, m in enumerate(left)}
            other = where if key[1] == key[2] else {m["source"]: k + len(left) for k, m in enumerate(right)}
            members = left if key[1] == key[2] else left + right
            place = where | other
            total = np.array([m["total"] for m in members], np.int64)
            value = np.zeros((len(members), len(members)), np.int64)
            seen = 0
            continue
        at, n = chunk.column("at").combine_chunks(), chunk.column("n").combine_chunks()
        row = np.repeat([place[s] for s in chunk.column("source").to_pylist()], np.diff(at.offsets.to_numpy()))
        used, column = np.unique(at.flatten().to_numpy(), return_inverse=True)
        counts = np.zeros((len(total), len(used)), np.int64)
        counts[row, column] = n.flatten().to_numpy()
        p = _shares(counts, total[:, None])
        for b in range(len(p)):
            away = p - p[b]
            value[:, b] += (away * away // p[b]).sum(axis=1)
        seen += len(used)
    if tile:
        yield from _summed(tile, left, right, value, seen)


def _summed(tile: tuple, left: list, right: list, value: np.ndarray, seen: int):
    """The pairs of a task: across its two blocks both ways, or all of one block."""
    lang, i, j, _ = tile
    one, two = [m["source"] for m in left], [m["source"] for m in right]
    if i == j:
        pairs = [(a, b, value[x, y]) for x, a in enumerate(one) for y, b in enumerate(one) if x != y]
    else:
        pairs = [(a, b, value[x, len(one) + y]) for x, a in enumerate(one) for y, b in enumerate(two)]
        pairs += [(b, a, value[len(one) + y, x]) for x, a in enumerate(one) for y, b in enumerate(two)]
    for k in range(0, len(pairs), 50_000):
        a, b, v = zip(*pairs[k : k + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(a), pa.array(b), pa.array(v, pa.int64()), pa.array(np.full(len(a), seen, np.int64))], names=["lang", "a", "b", "value", "seen"])


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(terms: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language."""
    tiles = _tiles(groups, langs)
    lacks = lambda c, kind: F.lit(None).cast(kind).alias(c)
    first = tiles.select("lang", "i", "j", "segment", F.lit(-1).alias("chunk"), lacks("source", "string"), lacks("at", "array<int>"), lacks("n", "array<bigint>"), F.col("left").cast(MEMBERS), F.col("right").cast(MEMBERS))
    vectors = _packed(terms, langs).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    vectors = vectors.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "segment", "chunk", "source", "at", "n", lacks("left", MEMBERS), lacks("right", MEMBERS))
    tasks = ["lang", "i", "j", "segment"]
    sums = first.union(vectors).repartition(*tasks).sortWithinPartitions(*tasks, "chunk").mapInArrow(_tiler, SUMS)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # terms that neither block has: the shares of a count of 0
    one = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("ta"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("tb"))
    every = one.join(two, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    none = F.lit(0).cast("bigint")
    rest = _apart(share(none, F.col("ta")), share(none, F.col("tb"))) * (F.col("v") - F.coalesce("seen", none))
    return every.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.when(F.col("v") > 0, F.coalesce("value", none) + rest).otherwise(none).alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """docs(text, lang, source) -> lang, source, part, item, value, rank.

    Part pair: how far the source's use of its language's terms is from each other source's,
    all of them ranked. Part term: the top terms that the source uses more than its language.
    p = 1 + floor(10^9 * (count + 1) / (all counts + terms)); a term's value is floor((p - q)^2 / q)."""
    counts = materialize(term_counts(docs), "term_counts")
    terms = materialize(vocabulary(counts, min_docs), "vocabulary")
    per = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("chief").cast("bigint")).alias("v"))
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term is null").select("lang", "source")
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = groups.join(sums, ["lang", "source"], "left").join(per, "lang", "left").select("lang", "source", zero("v").alias("v"), (zero("n") + zero("v")).alias("total"), (zero("lang_total") + zero("v")).alias("lang_total"))
    groups = materialize(groups, "groups")
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.max("v") / CHUNK).alias("chunks"))
    langs = materialize(langs.withColumn("segments", F.ceil(F.col("chunks") / SEGMENT).cast("int")), "langs")

    pairs = divergences(terms.select("lang", "source", "term", "n"), groups, langs)
    within = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(within).alias("rank"))
    used = terms.join(few(groups.select("lang", "source", "total", "lang_total")), ["lang", "source"])
    used = used.select("lang", "source", F.col("term").cast("string").alias("item"), share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q")).where("p > q")
    used = used.select("lang", "source", F.lit("term").alias("part"), "item", _apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    out = materialize(pairs.unionByName(used), "divergence")
    for table in (counts, terms, groups, langs):
        discard(table)
    return out
