"""Operator 5, language identification: words first, then shorter and shorter n-grams.

A word that the model knows scores by its log frequency in each language. An unseen
word falls back to its character n-grams of 5, 4, 3, 2 and at last 1 characters: the
longest order of which the model knows any n-gram scores it.

The model is fitted on a bounded sample of labelled rows, SAMPLE_DOCS of each language by
hash of doc_id, and keeps every language, word and n-gram of that sample: nothing is cut.
Words and n-grams are known by 64-bit hashes. Prediction reads every whole text.

The model is a table of counts, written once. Up to MODEL_ROWS rows it is broadcast and texts are
scored in batches; a larger one is joined with the distinct words of the texts, and never
passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import few, give_back, materialize

#: Labelled rows of each language that the model is fitted on.
SAMPLE_DOCS = 1000
ORDERS = (5, 4, 3, 2, 1)
FLOOR = 0.5
#: Rows of counts (some 30 bytes each) up to which the model is broadcast.
MODEL_ROWS = 8_000_000
#: Characters of text that are scored at once, unless one text is longer.
CHARS = 250_000
WORDS = regex.compile(r"[\p{L}\p{M}]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and combining marks, lower-cased."""
    return WORDS.findall(text.lower())


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def hash_of(strings: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(strings, object)).view(np.int64) if strings else np.zeros(0, np.int64)


class Model:
    """Log frequencies: for words (order 0) and n-grams of each order a floor per language,
    and for each known key what the languages that have it score above their floor."""

    def __init__(self, counts: pa.Table):
        """counts(order, key, lang, n): key the hash of a word or n-gram of that order, n above 0."""
        self.langs = sorted(pc.unique(counts["lang"]).to_pylist())
        lang = pc.index_in(counts["lang"], value_set=pa.array(self.langs, pa.string())).to_numpy()
        order, key, n = (counts[c].to_numpy() for c in ("order", "key", "n"))
        rows = {o: np.flatnonzero(order == o) for o in (0, *ORDERS)}
        rows = {o: r[np.lexsort((lang[r], key[r]))] for o, r in rows.items()}
        known = {o: len(np.unique(key[r])) for o, r in rows.items()}
        grams = sum(known[o] for o in ORDERS)
        self.keys, self.first, self.at, self.above, self.floor = {}, {}, {}, {}, {}
        for o, r in rows.items():
            total = 1 + np.bincount(lang[r], n[r], len(self.langs))
            self.floor[o] = np.log(FLOOR / (total + FLOOR * max(1, known[o] if o == 0 else grams)))
            self.keys[o], first = np.unique(key[r].astype(np.int64), return_index=True)
            self.first[o] = np.append(first, len(r)).astype(np.int64)
            self.at[o], self.above[o] = lang[r].astype(np.int32), np.log((n[r] + FLOOR) / FLOOR).astype(np.float32)

    def _known(self, order: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes that the order knows, their scores: a row each, a column a language)."""
        keys = self.keys[order]
        row = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        at = np.flatnonzero(keys[row] == hashes) if len(keys) else np.zeros(0, np.int64)
        first, n = self.first[order][row[at]], self.first[order][row[at] + 1] - self.first[order][row[at]] if len(at) else at
        out = np.tile(self.floor[order], (len(at), 1))
        cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n) if len(at) else at
        out[np.repeat(np.arange(len(at)), n), self.at[order][cell]] += self.above[order][cell]
        return at, out

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each language; all alike where nothing is known."""
        out = np.zeros((len(words), len(self.langs)))
        at, rows = self._known(0, hash_of(words))
        out[at] = rows
        left = np.setdiff1d(np.arange(len(words)), at)
        for n in ORDERS:
            if not len(left):
                break
            grams = [grams_of(words[k], n) for k in left]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            at, rows = self._known(n, hash_of([g for x in grams for g in x]))
            owner = owner[at]
            mine, start, times = np.unique(owner, return_index=True, return_counts=True)
            if len(mine):  # the mean of the known n-grams of this order
                out[left[mine]] = np.add.reduceat(rows, start, axis=0) / times[:, None]
            left = np.delete(left, mine)
        return out

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Of each text the language and its share of the odds; "und" and 0 without a letter or language."""
        words = [words_of(t) if t else [] for t in texts]
        code, distinct = pd.factorize(np.array([w for x in words for w in x], object))
        scores = self.scores(distinct.tolist())
        letters = np.array([has_letter(w) for w in distinct], bool)
        at = 0
        for x in words:
            mine = code[at : at + len(x)]
            at += len(x)
            if not self.langs or not letters[mine].any():
                yield "und", 0.0
                continue
            sums = scores[mine].sum(axis=0)
            odds = np.exp(sums - sums.max())
            best = int(odds.argmax())
            yield self.langs[best], float(odds[best] / odds.sum())


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def _words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: words_of(t) if t else [])


def _hashes(words: pd.Series) -> pd.Series:
    return pd.Series(hash_of(words.tolist()))


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(w, lang, n) -> (order, key, lang, n): the n-grams of all orders, added up in each batch."""
    for batch in batches:
        for n in ORDERS:
            grams = [grams_of(w, n) for w in batch["w"]]
            row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            key = hash_of([g for x in grams for g in x])
            rows = pd.DataFrame({"order": n, "key": key, "lang": batch["lang"].to_numpy(object)[row], "n": batch["n"].to_numpy()[row]})
            yield rows.groupby(["order", "key", "lang"], as_index=False)["n"].sum()


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """labelled(doc_id, text, lang) -> the model: counts(order, key, lang, n), written to the shared folder. The sample is the same on every run: of each
    language the rows with the least hash of doc_id, ties by doc_id and text. Rows without
    text, lang or letters teach nothing; without any the model has no language."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    # a hash threshold takes about twice the sample where rows are read, so that the
    # window meets few rows of a language however many there are
    h = F.xxhash64(F.col("doc_id").cast("string"))
    per_lang = materialize(rows.groupBy("lang").agg(F.count("*").alias("_k")), "languages")
    share = F.shiftrightunsigned(h, 11) / F.lit(float(2**53))
    some = rows.join(few(per_lang), "lang").where(share * F.col("_k") < 2.0 * sample_docs + 50)
    least = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned(h, 11), "doc_id", F.xxhash64("text")))
    sample = some.withColumn("_n", least).where(F.col("_n") <= sample_docs)
    per_word = sample.select("lang", F.explode(F.pandas_udf(_words, "array<string>")("text")).alias("w")).groupBy("w", "lang").agg(F.count("*").alias("n"))
    per_word = materialize(per_word, "words")
    words = per_word.select(F.lit(0).alias("order"), F.pandas_udf(_hashes, "bigint")("w").alias("key"), "lang", "n")
    grams = per_word.select("w", "lang", "n").mapInPandas(_grams, "order int, key bigint, lang string, n bigint")
    grams = grams.groupBy("order", "key", "lang").agg(F.sum("n").alias("n"))
    return materialize(words.union(grams.select("order", "key", "lang", "n")), "model")


LABEL = "lang_pred string, score double, letters boolean"


def judged(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """docs, all columns, and p: struct(lang_pred, score, letters) of the column text."""
    return _by_broadcast(docs, counts) if counts.count() <= MODEL_ROWS else _by_join(docs, counts)


def _by_broadcast(docs: DataFrame, counts: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Model(counts.toArrow()))

    @F.pandas_udf(LABEL)
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        rows = [(*p, has_letter(t)) for part in _chunks(texts.tolist()) for t, p in zip(part, own.predict(part))]
        give_back()
        return pd.DataFrame(rows, columns=["lang_pred", "score", "letters"])

    return docs.withColumn("p", predict("text"))


def _by_join(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """As Model does it, word by word: each distinct word of the texts is scored once, in joins with the
    counts of its hash, of its n-grams of the longest known order else; a document adds up its words."""
    names = docs.columns
    numbered = materialize(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()), "documents")
    text = F.col(f"c{names.index('text')}")
    said = numbered.select("row", F.explode(F.pandas_udf(_words, "array<string>")(text)).alias("w")).groupBy("row", "w").agg(F.count("*").alias("times"))
    said = materialize(said, "said")
    langs, floors = _floors(counts)
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    above = counts.select("order", "key", place.alias("l"), F.log((F.col("n") + F.lit(FLOOR)) / F.lit(FLOOR)).alias("above"))
    known = above.groupBy("order", "key").agg(F.collect_list(F.struct("l", "above")).alias("above"))
    left = materialize(said.select("w").distinct(), "words")
    found = None
    for order in (0, *ORDERS):
        if order:
            pieces = left.select("w", F.posexplode(F.pandas_udf(lambda w, n=order: w.map(lambda x: grams_of(x, n)), "array<string>")("w")).alias("at", "gram"))
        else:
            pieces = left.select("w", F.lit(0).alias("at"), F.col("w").alias("gram"))
        pieces = pieces.select("w", "at", F.pandas_udf(_hashes, "bigint")("gram").alias("key"))
        hit = pieces.join(known.where(F.col("order") == order).drop("order"), "key")
        # the mean over the known pieces; a word itself is one piece
        of = hit.groupBy("w").agg(F.lit(order).alias("order"), F.count("*").alias("pieces"), F.flatten(F.collect_list("above")).alias("above"))
        of = materialize(of, "scored")
        found = of if found is None else found.union(of)
        left = materialize(left.join(of, "w", "left_anti"), "words")
    each = said.join(found, "w").select("row", "order", "times", F.transform("above", lambda a: F.struct(a["l"].alias("l"), (a["above"] * F.col("times") / F.col("pieces")).alias("a"))).alias("above"))
    # sums by language and by order, both few a document, before they meet in its row
    by_lang = each.select("row", F.explode("above").alias("x")).groupBy("row", "x.l").agg(F.sum("x.a").alias("a")).groupBy("row").agg(F.collect_list(F.struct("l", "a")).alias("above"))
    by_order = each.groupBy("row", "order").agg(F.sum("times").alias("n")).groupBy("row").agg(F.collect_list(F.struct("order", "n")).alias("orders"))

    @F.pandas_udf("lang_pred string, score double")
    def best(above: pd.Series, orders: pd.Series, letters: pd.Series) -> pd.DataFrame:
        out = []
        for a, o, letter in zip(above, orders, letters):
            if not letter or not langs:
                out.append(("und", 0.0))
                continue
            sums = np.zeros(len(langs))
            for x in o if o is not None else ():
                sums += x["n"] * floors[x["order"]]
            for x in a if a is not None else ():
                sums[x["l"]] += x["a"]
            odds = np.exp(sums - sums.max())
            out.append((langs[int(odds.argmax())], float(odds.max() / odds.sum())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    letter = F.pandas_udf(lambda t: t.map(has_letter), "boolean")(text)
    rows = numbered.withColumn("letters", letter).join(by_lang, "row", "left").join(by_order, "row", "left").withColumn("b", best("above", "orders", "letters"))
    p = F.struct("b.lang_pred", "b.score", "letters").alias("p")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], p)


def _floors(counts: DataFrame) -> tuple[list[str], dict[int, np.ndarray]]:
    """The languages in order, and for each order what a piece scores that a language lacks; a number a language and order."""
    total = counts.groupBy("order", "lang").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in total})
    known = {r.order: r.n for r in counts.groupBy("order").agg(F.countDistinct("key").alias("n")).collect()}
    grams = sum(known.get(o, 0) for o in ORDERS)
    out = {}
    for o in (0, *ORDERS):
        sums = np.ones(len(langs))
        for r in total:
            if r.order == o:
                sums[langs.index(r.lang)] += r.n
        out[o] = np.log(FLOOR / (sums + FLOOR * max(1, known.get(0, 0) if o == 0 else grams)))
    return langs, out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from documents outside the fold whose crc32(doc_id as text) mod 5 is 0, from
    text and lang alone. lang_pred is a learned language, or "und" with score 0 where
    the text is null or empty or has no letter or nothing was learned. Languages that score
    alike: the least name. Very long texts are scored whole. A null doc_id is not held out
    and teaches nothing. Equal texts get equal answers, repeated rows one each. Other
    columns are ignored. Empty in, empty out.
    """
    taught = docs.where(~held_out()).select("doc_id", "text", "lang")
    out = judged(docs.select("doc_id", "text"), fit(taught)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "p")
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
