"""Operator 1, fuzzy line dedup by MinHash.

Signatures are made by numpy over Arrow batches, all else is SQL functions: in SQL functions
alone the operator doesn't keep the limits it was given (figures in the README).

A line's shingles are its 5-character pieces at every place. Distinct normalised lines get
60 minimum hashes: the hash of a shingle says which of 4 groups it is in, and each group has
15 minima, so that a shingle costs 15 comparisons. They make 30 bands of 7 values each, any
two bands with one value in common at most. Links are confirmed by the exact Jaccard
similarity of the same shingles, and union-find keeps one line per component. Two lines of
similarity 0.8 share a band with probability 0.99, of 0.85 with 0.999 (measured in a test).

Before texts are fetched, pairs are sieved by signs. A sign has 256 bins of shingles: bins that
one line fills and the other doesn't are shingles they don't share, which bounds the similarity
from above, exactly. It also has two bits of each of the 60 values: lines with many shingles
that agree in fewer than AGREE of them are put aside; at similarity 0.8 that is more than six
standard deviations below the mean.

Each line is first compared with one hub, the least line of its buckets. In a bucket that then
still holds several components all lines outside its largest component meet all others, in
blocks, inside a task; only pairs that pass the sieve leave it and are verified. In the first
FORESTS rounds a task gives no more of them than would join its components, as most are links
and leave little for the last round, which gives all. So no link between members of a bucket
is lost.

Lines are told apart by 128 bits. Candidates are known by 64 of them; where lines share those,
all of them are fetched and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, few, join_components, materialize
from lumenfold.llm.runs import runs

WIDTH = 5
VALUES = 60
#: Bands are shifts of one set of values whose differences are all distinct.
BANDS = [[(2 * b + k) % VALUES for k in (0, 1, 4, 10, 18, 23, 25)] for b in range(30)]
#: Groups of shingles, and minimum hashes of each.
GROUPS, EACH = 4, VALUES // 4
#: Lines of at most so many shingle places get a second key for each band, of its first 2
#: values: few shingles leave few different minima, and one that differs spoils many bands.
SHORT = 24
#: Values of 60 that candidates agree on at least, if both fill FILLED bins, which takes as many
#: different shingles.
AGREE, FILLED = 30, 30
#: Lines outside a bucket's largest component that one task holds; pairs that it compares at once.
BLOCK, CELLS = 2048, 1 << 21
#: Tasks of at most so many pairs are compared together, as many as a batch has.
FEW = 4096
#: Rounds in which pairs that would join components already joined are put off.
FORESTS = 2
#: Characters that are signed at once, unless one line is longer; names that a task knows as signed.
CHARS, NAMES = 500_000, 200_000
SIGN = ["low", "high", "b0", "b1", "b2", "b3", "places"]
SIGNED = f"line bigint, sign struct<{','.join(f'{c}:bigint' for c in SIGN)}>"
PACKED, MEMBERS = "part bigint, keys binary, lines binary", "key bigint, line bigint, hub bigint"
#: Ranges of keys for each shuffle partition; keys that a task holds before it gives them.
RANGES, PACK = 16, 1 << 20
PAD = "\0" * (WIDTH - 1)

_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 2**32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32)
_MIX = _RNG.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)


def normalize(line: Column) -> Column:
    """Lower-cased, ends trimmed of white space; bytes that are no UTF-8 are replaced."""
    return F.btrim(F.lower(F.make_valid_utf8(line)), F.lit(" \t\n\x0b\x0c\r"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no from 0, norm, line and second: every line of every text, blank ones too;
    line and second are two hashes of norm, null where it is blank. A null text has no line."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", normalize(F.col("line")).alias("norm"))
    some = lambda c, name: F.when(F.col("norm") != "", c).alias(name)
    return rows.select("doc_id", "line_no", "norm", some(F.xxhash64("norm"), "line"), some(F.xxhash64(F.lit(7), "norm"), "second"))


def shingles(norm: str) -> str:
    """SQL of the distinct hashes of all shingles; a line shorter than WIDTH is one shingle.

    Four bytes a character make a shingle's place in the line known without a walk to it."""
    return f"""array_distinct(transform(array(encode({norm}, 'UTF-32')), b -> transform(
        sequence(1, greatest(length(b) - {4 * WIDTH - 1}, 1), 4), i -> xxhash64(substring(b, i, {4 * WIDTH}))))[0])"""


def hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, which line it is of): all places of all lines, in order."""
    # four zeros behind each line, so that a short one is one shingle
    points = np.frombuffer((PAD.join(lines) + PAD).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    places = np.maximum(size - (WIDTH - 1), 1)
    begin = np.cumsum(size + len(PAD)) - size - len(PAD)
    owner = np.repeat(np.arange(len(lines)), places)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places - begin, places)
    h = points[at].astype(np.uint64) * _MIX[0]
    for k in range(1, WIDTH):
        h += points[at + k] * _MIX[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, owner


def minima(h: np.ndarray, owner: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, a column a line; whether its group has a shingle; bins) of shingles in the order of their lines."""
    values, there, bins = np.zeros((VALUES, lines), np.uint32), np.zeros((VALUES, lines), bool), np.zeros((GROUPS, lines), np.uint64)
    for g in range(GROUPS):
        mine = np.flatnonzero((h & np.uint64(GROUPS - 1)) == g)
        if not len(mine):
            continue
        one, of = h[mine], owner[mine]
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        row = of[start]
        bins[g, row] = np.bitwise_or.reduceat(np.uint64(1) << ((one >> np.uint64(2)) & np.uint64(63)), start)
        one = (one >> np.uint64(32)).astype(np.uint32)
        work = np.empty_like(one)
        for v in range(g * EACH, (g + 1) * EACH):
            np.multiply(one, _MUL[v], out=work)
            np.add(work, _ADD[v], out=work)
            values[v, row], there[v, row] = np.minimum.reduceat(work, start), True
    return values, there, bins


def keys_of(values: np.ndarray, there: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lines): a key for each band of which a line has a value, one of two values more for each band of a short line that has both."""
    keys, lines = [], []
    for b, band in enumerate(BANDS + [band[:2] for band in BANDS]):
        has = there[band].all(axis=0) & short if b >= len(BANDS) else there[band].any(axis=0)
        at = np.flatnonzero(has)
        key = np.full(len(at), b + 1, np.uint64)
        for v in band:
            key = (key ^ values[v, at]) * _MIX[0]
            key ^= key >> np.uint64(31)
        keys.append(key * _MIX[1])
        lines.append(at)
    return np.concatenate(keys).view(np.int64), np.concatenate(lines)


def sign_of(values: np.ndarray, bins: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The columns SIGN: two bits of each value, the bins, and the places of shingles."""
    at = np.arange(VALUES, dtype=np.uint64)[:, None]
    bits = [(((values >> np.uint32(k)) & np.uint32(1)).astype(np.uint64) << at).sum(axis=0, dtype=np.uint64) for k in (5, 11)]
    return [x.view(np.int64) for x in (*bits, *bins)] + [places.astype(np.int64)]


def _slices(names: list, lines: pa.Array):
    """(names, lines) of some CHARS at a time, or of one longer line."""
    some, texts, size = [], [], 0
    for name, line in zip(names, lines):
        some.append(name)
        texts.append(line.as_py())
        size += len(texts[-1])
        if size > CHARS:
            yield some, texts
            some, texts, size = [], [], 0
    if texts:
        yield some, texts


def _packed(keys: np.ndarray, lines: np.ndarray, ranges: int) -> pa.RecordBatch:
    """PACKED: the keys and lines of each range of keys, one row a range."""
    order = np.argsort(keys)
    keys, lines = keys[order], lines[order]
    part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = pa.array(np.append(start, len(keys)) * 8, pa.int32()).buffers()[1]
    column = lambda x: pa.Array.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(np.ascontiguousarray(x))])
    return pa.RecordBatch.from_arrays([pa.array(part[start].astype(np.int64)), column(keys), column(lines)], names=["part", "keys", "lines"])


def _packer(ranges: int):
    """line, second, norm -> PACKED: the band keys of each line. A line that comes again may be signed again."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        keys, lines, held = [], [], 0
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in (0, 1))))
            fresh = []
            for k, name in enumerate(names):
                if name not in seen:
                    seen.add(name)
                    fresh.append(k)
            for some, texts in _slices([names[k][0] for k in fresh], batch.column(2).take(pa.array(fresh, pa.int64()))):
                h, owner = hashes(texts)
                values, there, _ = minima(h, owner, len(texts))
                key, at = keys_of(values, there, np.bincount(owner, minlength=len(texts)) <= SHORT)
                keys.append(key.view(np.uint64))
                lines.append(np.array(some, np.int64)[at])
                held += len(at)
                if held > PACK:
                    yield _packed(np.concatenate(keys), np.concatenate(lines), ranges)
                    keys, lines, held = [], [], 0
            if len(seen) > NAMES:
                seen.clear()
        if held:
            yield _packed(np.concatenate(keys), np.concatenate(lines), ranges)

    return run


def _shared(batches):
    """PACKED, sorted by part -> MEMBERS: the lines of each key that several lines have."""
    for group in runs(batches, ["part"]):
        unpack = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), kind)  # noqa: B023, E731
        keys, lines = unpack("keys", np.uint64), unpack("lines", np.int64)
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        keys, lines = keys[order], lines[order]
        order = np.lexsort((lines, keys))
        keys, lines = keys[order], lines[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])
        keys, lines = keys[once], lines[once]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(keys)))
        hub, several = np.repeat(lines[start], size), np.repeat(size > 1, size)
        if several.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (keys.view(np.int64), lines, hub)], names=["key", "line", "hub"])


def _signer(batches):
    """line, norm -> line, sign."""
    kind = pa.struct([(c, pa.int64()) for c in SIGN])
    for batch in batches:
        for names, texts in _slices(batch.column(0).to_pylist(), batch.column(1)):
            h, owner = hashes(texts)
            values, _, bins = minima(h, owner, len(texts))
            sign = pa.StructArray.from_arrays([pa.array(c) for c in sign_of(values, bins, np.bincount(owner, minlength=len(texts)))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), sign], names=["line", "sign"])


def shared_keys(lines: DataFrame) -> DataFrame:
    """lines(line, second, norm), repeats and all -> MEMBERS: (key, line, hub) of the band keys that several lines
    have; hub is the least of them. Keys are shuffled as arrays, one row for each task and range of
    keys: a row a key costs half as much again on disk and most of the sorting. A task puts one range in order at a time."""
    ranges = RANGES * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = lines.select("line", "second", "norm").mapInArrow(_packer(ranges), PACKED)
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(_shared, MEMBERS)


def _alike(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) that pass the sieve."""
    rows = pairs
    for end in ("a", "b"):
        rows = rows.join(signs.select(F.col("line").alias(end), F.col("sign").alias(f"s{end}")), end)
    bins = range(GROUPS)
    apart = F.expr(" + ".join(f"bit_count(sa.b{g} ^ sb.b{g})" for g in bins))
    filled = F.expr(f"least({' + '.join(f'bit_count(sa.b{g})' for g in bins)}, {' + '.join(f'bit_count(sb.b{g})' for g in bins)})")
    agree = F.lit(VALUES) - F.bit_count(F.expr("(sa.low ^ sb.low) | (sa.high ^ sb.high)"))
    may = apart * (100 + percent) <= (F.col("sa.places") + F.col("sb.places")) * (100 - percent)
    return rows.where(may & ((filled < FILLED) | (agree >= AGREE))).select("a", "b").distinct()


def passes(one: list[np.ndarray], two: list[np.ndarray], percent: int) -> np.ndarray:
    """The sieve of columns SIGN against others, as a table."""
    return _sieve([c[:, None] for c in one], [c[None, :] for c in two], percent)


def _sieve(one: list[np.ndarray], two: list[np.ndarray], percent: int) -> np.ndarray:
    count = lambda x: np.bitwise_count(x.view(np.uint64)).astype(np.int64)
    apart = sum(count(a ^ b) for a, b in zip(one[2 : 2 + GROUPS], two[2 : 2 + GROUPS]))
    filled = [sum(map(count, side[2 : 2 + GROUPS])) for side in (one, two)]
    agree = VALUES - count((one[0] ^ two[0]) | (one[1] ^ two[1]))
    may = apart * (100 + percent) <= (one[-1] + two[-1]) * (100 - percent)
    return may & ((np.minimum(*filled) < FILLED) | (agree >= AGREE))


class _Joins:
    """Components that pairs would join."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def _top(self, x: int) -> int:
        while x in self.up:
            x = self.up[x]
        return x

    def new(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """The places of pairs that join two components which none before joined."""
        _, first = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0, return_index=True)
        out = []
        for k in first.tolist():
            a, b = self._top(int(x[k])), self._top(int(y[k]))
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append(k)
        return out


def _comparer(percent: int, forest: bool):
    """Tasks (key, part) sorted, the lines outside the largest component first -> pairs (a, b) that pass the
    sieve; with forest only those that join components of the task."""

    def together(batch: pa.RecordBatch, first: np.ndarray, outer: np.ndarray, every: np.ndarray):
        """The pairs of small tasks, whole in the batch: each begins at first with outer lines outside, then every line."""
        get = lambda c: np.asarray(batch.column(batch.schema.get_field_index(c)))
        line, comp, sign = get("line"), get("comp"), [get(c) for c in SIGN]
        pairs = outer * every
        task = np.repeat(np.arange(len(first)), pairs)
        at = np.arange(len(task)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = first[task] + at // every[task], first[task] + outer[task] + at % every[task]
        some = comp[i] != comp[j]
        i, j, task = i[some], j[some], task[some]
        some = _sieve([c[i] for c in sign], [c[j] for c in sign], percent)
        i, j, task = i[some], j[some], task[some]
        if forest and len(i):
            # components of each task by themselves
            _, own = np.unique(np.stack([np.tile(task, 2), np.concatenate([comp[i], comp[j]])]), axis=1, return_inverse=True)
            own = own.reshape(-1)
            k = _Joins().new(own[: len(i)], own[len(i) :])
            i, j = i[k], j[k]
        a, b = line[i], line[j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def rest(batches, done: list):
        """What is left of batches without the small tasks, whose pairs go to done."""
        for batch in batches:
            get = lambda c: np.asarray(batch.column(batch.schema.get_field_index(c)))  # noqa: B023, E731
            key, part = get("key"), get("part")
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])) if len(key) else np.zeros(0, np.int64)
            if len(first) < 3:
                yield batch
                continue
            size = np.diff(np.append(first, len(key)))
            every = np.add.reduceat(get("side").astype(np.int64), first)
            outer = size - every
            # the first and the last may go on in other batches
            small = outer * every <= FEW
            small[[0, -1]] = False
            if small.any():
                done.append(together(batch, first[small], outer[small], every[small]))
            yield batch.filter(pa.array(np.repeat(~small, size)))

    def run(batches):
        last, held, joins, done = None, None, None, []
        for group in runs(rest(batches, done), ["key", "part", "side"], CELLS // BLOCK):
            while done:
                yield done.pop()
            task = (group.column("key")[0].as_py(), group.column("part")[0].as_py())
            get = lambda c: np.asarray(group.column(c))
            rows = [get("line"), get("comp"), [get(c) for c in SIGN]]
            if group.column("side")[0].as_py() == 0:
                if task != last:
                    last, held, joins = task, [], _Joins()
                held.append(rows)
                continue
            if task != last:
                continue
            for line, comp, sign in held:
                i, j = np.nonzero(passes(sign, rows[2], percent) & (comp[:, None] != rows[1][None, :]))
                if len(i):
                    if forest:
                        k = joins.new(comp[i], rows[1][j])
                        i, j = i[k], j[k]
                    a, b = line[i], rows[0][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        while done:
            yield done.pop()

    return run


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids that are similar on their full sets of shingles; pairs has lines."""
    left = texts.select(F.col("line").alias("a"), F.col("id").alias("ia"), F.col("norm").alias("ta"))
    right = texts.select(F.col("line").alias("b"), F.col("id").alias("ib"), F.col("norm").alias("tb"))
    near = pairs.join(left, "a").join(right, "b").select("ia", "ib", F.expr(f"struct({shingles('ta')} as x, {shingles('tb')} as y)").alias("s"))
    # a generator between: else plans make the sets again at every use, and inside a lambda sets are met uncompiled
    near = near.select("ia", "ib", F.explode(F.array("s")).alias("s")).select("ia", "ib", F.expr("struct(size(s.x) as x, size(s.y) as y, size(array_intersect(s.x, s.y)) as n)").alias("s"))
    near = near.select("ia", "ib", F.explode(F.array("s")).alias("s"))
    return near.where(F.expr(f"s.n * 100 >= (s.x + s.y - s.n) * {percent}")).select(F.col("ia").alias("a"), F.col("ib").alias("b"))


def _ordered(line: str, other: str) -> list[Column]:
    return [F.least(line, other).alias("a"), F.greatest(line, other).alias("b")]


def _open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """members(key, line, id) of the buckets that hold several components, with comp."""
    named = members.join(found.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    several = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return named.join(several, "key").select("key", "line", "id", "comp")


def _largest(named: DataFrame) -> DataFrame:
    """(key, main, rest): a bucket's largest component and how many members are outside it."""
    size = named.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"))
    return size.select("key", F.col("m.comp").alias("main"), (F.col("all") - F.col("m.c")).alias("rest"))


def _within_buckets(named: DataFrame, signs: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of open buckets that pass the sieve, with forest few of them, compared inside tasks: lines outside a bucket's largest
    component, BLOCK a task, against all of its lines, which stream by."""
    parts = _largest(named).select("key", "main", F.ceil(F.col("rest") / BLOCK).cast("int").alias("parts"))
    rows = named.join(parts, "key").join(signs.select("line", "sign.*"), "line")
    out = rows.where("comp <> main").withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int")).withColumn("side", F.lit(0))
    every = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1))
    columns = ["key", "part", "side", "line", "comp", *SIGN]
    both = out.select(*columns).union(every.select(*columns))
    return both.repartition("key", "part").sortWithinPartitions("key", "part", "side").mapInArrow(_comparer(percent, forest), "a bigint, b bigint").distinct()


def line_components(lines: DataFrame, percent: int = 80) -> DataFrame:
    """lines(line, second, norm), repeats and all -> (line, second, comp) of the lines that have links."""
    every = materialize(shared_keys(lines), "members")
    members = every.drop("hub")
    some = materialize(members.select("line").distinct(), "some")
    texts = lines.join(few(some), "line", "left_semi").groupBy("line", "second").agg(F.first("norm").alias("norm"))
    texts = materialize(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    signs = materialize(texts.select("line", "norm").mapInArrow(_signer, SIGNED), "signs")
    used = [every, some, texts, signs]

    def linked(close: DataFrame, found: DataFrame | None) -> DataFrame:
        links = materialize(_verified(close, texts, percent), "links")
        out = join_components(found, links)
        used.extend([close, links, out])
        return out

    hubs = every.where("line <> hub").groupBy("line").agg(F.min("hub").alias("hub")).select(*_ordered("line", "hub")).distinct()
    found = linked(materialize(_alike(hubs, signs, percent), "close"), None)
    members = members.join(few(texts.select("line", "id")), "line")
    tested = None
    for turn in range(FORESTS + 1):
        # what no round has left open stays closed
        members = materialize(_open_buckets(members, found), "open")
        used.append(members)
        if members.isEmpty():
            break
        close = _within_buckets(members, signs, percent, turn < FORESTS)
        close = materialize(close if tested is None else close.join(tested, ["a", "b"], "left_anti"), "close")
        tested = close if tested is None else tested.union(close)
        found = linked(close, found)
        members = members.drop("comp")
    out = materialize(texts.select("line", "second", "id").join(found.select(F.col("node").alias("id"), "comp"), "id").select("line", "second", "comp"), "linked")
    for table in [*used, found]:
        discard(table)
    return out


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per line: doc_id, line_no, kept, keep_doc_id, keep_line_no.

    Of each component (equal lines included) the line of the least (doc_id, line_no)
    stays. Blank lines all stay and keep themselves. Null and empty texts: none, and one
    blank line. Very long lines are read whole. Repeated rows: the first of equals stays,
    and so do rows that share its doc_id and line_no. A null doc_id orders last. Other
    columns of docs are ignored, whatever their names. Empty in, empty out.
    """
    lines = lines_of(docs)
    comps = line_components(lines.where("line is not null").select("line", "second", "norm"), percent)
    # blank lines take no part in the joins
    rows = lines.where("line is not null").drop("norm").join(few(comps), ["line", "second"], "left")
    own = F.when(F.col("comp").isNull(), F.struct("line", "second"))
    rows = materialize(rows.select("doc_id", "line_no", F.struct("comp", own.alias("own")).alias("comp")), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    best = rows.groupBy("comp").agg(F.count("*").alias("n"), F.min(place).alias("w")).where("n > 1").select("comp", "w")
    found = rows.join(best, "comp", "left").select("doc_id", "line_no", "w")
    blank = lines.where("line is null").select("doc_id", "line_no", F.lit(None).cast(found.schema["w"].dataType).alias("w"))
    out = found.union(blank)
    alone = F.col("w").isNull()
    keep_doc, keep_line = F.when(alone, F.col("doc_id")).otherwise(F.col("w.doc_id")), F.when(alone, F.col("line_no")).otherwise(F.col("w.line_no"))
    return out.select("doc_id", "line_no", (keep_doc.eqNullSafe(F.col("doc_id")) & (keep_line == F.col("line_no"))).alias("kept"), keep_doc.alias("keep_doc_id"), keep_line.alias("keep_line_no"))


def rewrite(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text with the kept lines only, in order: a row per row of docs.

    decided is what dedup_lines() says of docs. Rows that lose all lines, or whose text is null, are
    empty. Rows of one doc_id, null too, are rewritten each: a line stays where dedup_lines() keeps
    that doc_id and line_no. A row's lines meet in one row, as its text did. Empty in, empty out."""
    numbered = materialize(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "texts")
    lines = numbered.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    stays = decided.where("kept").select(F.col("doc_id").alias("id"), F.col("line_no").alias("no")).distinct()
    kept = lines.join(stays, lines["doc_id"].eqNullSafe(stays["id"]) & (lines["line_no"] == stays["no"]), "left_semi")
    whole = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return numbered.join(whole, "row", "left").select("doc_id", F.concat_ws("\n", F.transform("l", lambda x: x["line"])).alias("text"))
