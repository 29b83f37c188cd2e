"""Operator 6, benchmark decontamination by training suffix arrays.

Every task cuts its training documents into shards of bounded size and builds each shard's
suffix array over word numbers by prefix doubling. Every benchmark suffix that still holds a
window is binary-searched in it; the range of suffixes that begin with its window gives all
places of the match, and each is followed to its longest verbatim length. A match is told by
item, place in the item, place in the document and length in words.

Nothing is shuffled for a benchmark of one block: documents stay where they are read. A
larger benchmark is dealt into blocks by hash; they are searched one after the other, so that
the driver and a task hold one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize, tidy

WINDOW = 10
#: Bytes of text a shard holds, unless one document is longer.
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text that a block holds on average. A larger benchmark makes more blocks.
BLOCK_BYTES = 16 << 20
#: Pairs of places that are followed at once.
PAIRS = 1 << 20

#: Bytes to word bytes: A-Z lower-cased, other ASCII but 0-9 and a-z to a space.
_FOLD = bytes(b if b > 0x7F or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 0x20 for b in range(256))

MATCHES = "array<struct<item:string,item_start:bigint,start:bigint,length:bigint>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def runs_of(numbers: np.ndarray) -> np.ndarray:
    """How many non-zero numbers follow from each place on."""
    place = np.arange(len(numbers))
    stop = np.where(numbers == 0, place, len(numbers))
    return np.minimum.accumulate(stop[::-1])[::-1] - place


def suffix_array(numbers: np.ndarray, run: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places at, ordered by the suffixes that begin there and end with their run.

    Prefix doubling: ranks by k numbers, paired with those k further, give ranks by 2k. With
    a place all later ones of its run are in at.
    """
    rank = np.zeros(len(numbers), np.int64)
    rank[at] = numbers[at]
    k, longest = 1, int(run[at].max()) if len(at) else 0
    order = np.argsort(rank[at], kind="stable")
    while k < longest:
        second = np.where(run[at] > k, rank[np.minimum(at + k, len(rank) - 1)], 0)
        key = rank[at] * (int(rank.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[1], (np.diff(ordered) > 0).astype(np.int64)])
        now = np.empty(len(at), np.int64)
        now[order] = np.cumsum(fresh)
        rank[at] = now
        if fresh.all():
            break
        k *= 2
    return at[order]


class Block:
    """Benchmark items ready for the search: their word numbers one behind the other, and the suffixes that hold a window."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.window, self.ids = window, [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        flat, begin, size = [0], [], []
        for _, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)]
            begin.append(len(flat))
            size.append(len(w))
            flat += [*w, 0]
        self.flat = np.array(flat, np.int64)
        need = np.minimum(np.array(size, np.int64), window)  # a short item is one window
        count = np.where(need > 0, np.array(size, np.int64) - need + 1, 0)
        self.owner = np.repeat(np.arange(len(items)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.begin = np.array(begin, np.int64)
        self.suffix = self.begin[self.owner] + offset if len(items) else offset
        self.need = need[self.owner] if len(items) else offset
        self.shortest = int(self.need.min()) if len(self.need) else 0

    def _keys(self, flat: np.ndarray, at: np.ndarray, length: np.ndarray, rest: int) -> np.ndarray:
        """The first window numbers behind each place as byte strings; behind length all are rest."""
        depth = np.arange(self.window)
        rows = np.concatenate([flat, np.zeros(self.window, flat.dtype)])[at[:, None] + depth]
        rows[depth >= length[:, None]] = rest
        return np.ascontiguousarray(rows, ">u4").view(f"S{4 * self.window}").ravel()

    def search(self, numbers: np.ndarray) -> np.ndarray:
        """numbers: a shard's words, 0 where unknown or between documents.

        All matches of a window or more that neither end extends: (place in the shard,
        place in flat, length, owner) as columns of one array."""
        none = np.zeros((0, 4), np.int64)
        if not len(self.suffix) or not len(numbers):
            return none
        run = runs_of(numbers)
        # places in stretches of benchmark words too short for any window can't match
        first = np.concatenate([[True], numbers[:-1] == 0]) & (numbers != 0)
        whole = run[np.maximum.accumulate(np.where(first, np.arange(len(numbers)), 0))]
        at = np.flatnonzero((numbers != 0) & (whole >= self.shortest))
        if not len(at):
            return none
        array = suffix_array(numbers, run, at)
        keys = self._keys(numbers, array, run[array], 0)
        low = np.searchsorted(keys, self._keys(self.flat, self.suffix, self.need, 0), "left")
        high = np.searchsorted(keys, self._keys(self.flat, self.suffix, self.need, 2**32 - 1), "right")
        n, out = high - low, []
        ends = np.cumsum(n)
        for a, b in _chunks(ends, PAIRS):
            k, base = n[a:b], ends[a:b] - n[a:b]
            which = np.repeat(np.arange(a, b), k)
            place = array[np.arange(base[0], ends[b - 1]) - np.repeat(base, k) + np.repeat(low[a:b], k)]
            item = self.suffix[which]
            # one further to the left it is part of a longer match
            before = np.where(place > 0, numbers[np.maximum(place - 1, 0)], 0)
            top = (before == 0) | (before != self.flat[item - 1])
            place, item, which = place[top], item[top], which[top]
            out.append(np.stack([place, item, self._follow(numbers, place, item, self.need[which]), self.owner[which]], 1))
        return np.concatenate(out) if out else none

    def _follow(self, numbers: np.ndarray, place: np.ndarray, item: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How far the words behind both places agree, length at least."""
        length, live = length.copy(), np.arange(len(place))
        padded = np.concatenate([numbers, [0]])
        while len(live):
            a, b = padded[place[live] + length[live]], self.flat[item[live] + length[live]]
            live = live[(a == b) & (a != 0)]
            length[live] += 1
        return length

    def judge(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
        """Of each text: its words, and its matches (number of the item, place there, place here, length)."""
        get = self.vocabulary.get
        numbers, bounds, sizes = [], [0], []
        for t in texts:
            w = words_of(t)
            numbers.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            sizes.append(len(w))
            bounds.append(bounds[-1] + len(w) + 1)
        gap = np.zeros(1, np.int64)
        found = self.search(np.concatenate([x for n in numbers for x in (n, gap)]) if numbers else gap)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        cut = np.searchsorted(found[:, 0], np.array(bounds))
        for k, n in enumerate(sizes):
            rows = found[cut[k] : cut[k + 1]]
            yield n, list(zip(rows[:, 3].tolist(), (rows[:, 1] - self.begin[rows[:, 3]]).tolist(), (rows[:, 0] - bounds[k]).tolist(), rows[:, 2].tolist()))


def _chunks(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of queries with at most `most` pairs, one query at least; those without pairs only between others."""
    a = 0
    while a < len(ends):
        done = ends[a - 1] if a else 0
        if done == ends[-1]:
            return
        b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
        yield a, b
        a = b


def _search(docs: DataFrame, items: list[tuple[str, bytes]], carry: list[str], window: int) -> DataFrame:
    """docs(carry..., text) -> carry..., n_words, matches against one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(Block(items, window))
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.select(*carry).dtypes] + ["n_words bigint", f"matches {MATCHES}"])

    def run(batches):
        fields = ["item", "item_start", "start", "length"]
        kind = pa.list_(pa.struct([("item", pa.string()), *[(f, pa.int64()) for f in fields[1:]]]))
        block = shared.value
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("_text"))
            for lo, hi in _cuts(col):
                texts = [t or b"" for t in col.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                n_words, matches = [], []
                for n, found in block.judge(texts):
                    n_words.append(n)
                    matches.append([dict(zip(fields, (block.ids[i], *rest))) for i, *rest in found])
                cols = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carry]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(matches, kind)], names=[*carry, "n_words", "matches"])

    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(tidy(run), schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(carry..., text) -> carry..., n_words, matches array<struct<item, item_start, start, length>>.

    One row per row of docs. A match is a longest run of words that a document and a
    benchmark item share, a window or more (a whole item, where it is shorter); places count
    words from 0. Every occurrence of a window lies in a match, and every word of a match in
    such an occurrence. Null or empty texts have no words and no matches, very long texts are
    one shard; repeated rows are searched each. Rows of one item_id with several texts are
    several items of that id, a null item_id is an empty one. An empty benchmark finds
    nothing, empty docs give no rows.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes)

    def block(k: int) -> list[tuple[str, bytes]]:
        mine = rows if blocks < 2 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        return [(r["i"], r["t"].encode()) for r in mine.collect()]

    if blocks < 2:
        return _search(docs, block(0), carry, window)
    numbered = materialize(docs.select(*dict.fromkeys([*carry, "text"])).withColumn("_row", F.monotonically_increasing_id()), "documents")
    found = None
    for k in range(blocks):
        part = materialize(_search(numbered, block(k), ["_row"], window).where("size(matches) > 0").select("_row", "matches"), "matches")
        found = part if found is None else found.union(part)
    words = _search(numbered, [], [*carry, "_row"], window).drop("matches")
    found = found.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    out = words.join(found, "_row", "left").drop("_row")
    return out.withColumn("matches", F.coalesce("matches", F.expr(f"cast(array() as {MATCHES})")))


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SHARD_BYTES of text, one row at least."""
    lo, room = 0, SHARD_BYTES
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if n > room and k > lo:
            yield lo, k
            lo, room = k, SHARD_BYTES
        room -= n
    if lo < len(texts):
        yield lo, len(texts)


#: Words in the union of all matches: ordered by start, each adds what lies behind the end so far.
HIT_WORDS = """aggregate(array_sort(transform(matches, m -> struct(m.start AS a, m.start + m.length AS b))),
    named_struct('end', 0L, 'n', 0L),
    (s, x) -> named_struct('end', greatest(s.end, x.b), 'n', s.n + greatest(0L, x.b - greatest(x.a, s.end))), s -> s.n)"""


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Ids that several benchmark rows share count once. Repeated documents are judged
    each. Ids are sorted as strings, joined by commas and hashed; with none, "" is. Other
    columns of docs are ignored, whatever their names.
    """
    found = find_leaks(docs, benchmark, ["doc_id"])
    found = found.select("doc_id", "n_words", F.expr(HIT_WORDS).alias("n_hit"), F.array_sort(F.array_distinct("matches.item")).alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that hold no benchmark window."""
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))]) if names else docs
    text = F.col(f"c{names.index('text')}")
    clean = find_leaks(renamed.withColumn("text", text), benchmark, renamed.columns).where("size(matches) = 0")
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
