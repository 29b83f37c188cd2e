import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import functions as F

from lumenfold.llm import chat, decontaminate, language_id, mixing, sharding, token_counts, url_filter
from lumenfold.llm.queries import RULES
from tests.llm import brute
from tests.llm.conftest import prose


def test_sharding(docs, rows):
    got = sharding.shard(docs, 8, 5).collect()
    assert len(got) == len(rows)
    for s in range(8):
        slots = [r.slot for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)]
        assert slots == list(range(len(slots)))
    for r in got:
        assert r.shard == brute.jump(r.doc_id or 0, 8) and r.grown_shard == brute.jump(r.doc_id or 0, 9) and r.grown_shard in (r.shard, 8)
    want = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want


def test_jump_hash_wide_keys(spark, monkeypatch):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345]
    for steps in (sharding.JUMPS, 2):  # with 2 steps most keys take the longer way
        monkeypatch.setattr(sharding, "JUMPS", steps)
        df = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", *[sharding.jump_hash("k", n).alias(f"n{n}") for n in (1, 2, 1000)])
        for r in df.collect():
            assert (r.n1, r.n2, r.n1000) == tuple(brute.jump(r.k, n) for n in (1, 2, 1000))


def test_mixing(docs, rows, empty):
    got = mixing.mix(mixing.sized(docs)).collect()
    assert len(got) == len(rows)
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        assert r.copies in (0, 1, 2)
        x = by.setdefault(r.source, [0, r.source_size, r.target, 0])
        x[0] += r.copies * r["size"]
        x[3] = max(x[3], r["size"])
    assert abs(sum(x[2] for x in by.values()) - 1.5 * total) < 1e-6 * total
    repeated = 3 * 80  # three equal rows go in or out together
    assert all(abs(x[0] - x[2]) <= max(x[3], repeated) / 2 + 1 and x[2] <= 2 * x[1] + 1e-6 for x in by.values())
    whole = mixing.mix_rows(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in got)
    assert mixing.mix(mixing.sized(empty)).count() == 0


def test_water_fill(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.water_fill(s, (3, 1, 2), 1.5, 2.0).collect()}
    want, sizes, w = {}, {"a": 10, "b": 1000, "c": 100, None: 50}, {"a": 3, "b": 1, "c": 2, None: 3}
    budget, open_ = 1.5 * 1160, set(sizes)
    while True:
        level = budget / sum(w[k] for k in open_)
        full = {k for k in open_ if level * w[k] > 2 * sizes[k]}
        if not full:
            break
        for k in full:
            want[k] = 2.0 * sizes[k]
            budget -= want[k]
        open_ -= full
    want |= {k: level * w[k] for k in open_}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_mixing_many_sources_are_salted(docs, monkeypatch):
    want = sorted(map(repr, mixing.mix(mixing.sized(docs)).select("doc_id", "size", "copies").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(mixing.sized(docs)).select("doc_id", "size", "copies").collect())) == want


def test_decontamination(docs, rows, spark, empty):
    items = [(1, rows[13][1][: len(rows[13][1]) // 2]), (2, "TWO words"), (3, None), (4, "!!"), (10, " ".join(rows[7][1].split()[5000:5030])), (11, prose(77, 40)), (12, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    text_of = {str(i): brute.bench_words(t) for i, t in items}
    for block_bytes in (decontaminate.BLOCK_BYTES, 100):
        got = decontaminate.find_leaks(docs, bench, ["doc_id", "text"], block_bytes=block_bytes).collect()
        have = []
        for r in got:
            hit, w = set(), brute.bench_words(r.text)
            for m in r.matches:
                assert text_of[m.item][m.item_start : m.item_start + m.length] == w[m.start : m.start + m.length]
                hit |= set(range(m.start, m.start + m.length))
            have.append(repr((r.doc_id, r.n_words, len(hit), sorted({m.item for m in r.matches}))))
        assert sorted(have) == sorted(repr((r[0], *brute.leaks(r[1], items))) for r in rows)
        whole = next(m for r in got if r.doc_id == 7 for m in r.matches)
        assert (whole.item, whole.item_start, whole.start, whole.length) == ("10", 0, 5000, 30)
    digests = decontaminate.contamination(docs, bench).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit)) for r in digests) == sorted(repr((r[0], *brute.leaks(r[1], items)[:2])) for r in rows)
    out = decontaminate.contamination(docs, bench).where("doc_id = 11").first()
    assert out.items_sha256 == hashlib.sha256(b"2").hexdigest() and out.contaminated
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and not {7, 11, 13} & {r.doc_id for r in clean.collect()}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_longest_matches_random(monkeypatch):
    """Matches are verbatim, no end extends, none is missing; pairs in small and large chunks."""
    r = random.Random(5)
    for pairs in (1, 7, 1 << 20):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        for _ in range(150):
            some = r.choice(["ab", "abc", "abcdefgh"])
            texts = [" ".join(r.choice(some + "?z") for _ in range(r.randrange(0, 60))) for _ in range(4)]
            items = [(k, " ".join(r.choice(some) for _ in range(r.randrange(0, 14)))) for k in range(4)]
            block = decontaminate.Block([(str(i), t.encode()) for i, t in items], 4)
            for t, (n, found) in zip(texts, block.judge([x.encode() for x in texts])):
                w, hit = brute.bench_words(t), set()
                for i, at, start, length in found:
                    x = brute.bench_words(items[i][1])
                    assert x[at : at + length] == w[start : start + length] and length >= min(4, len(x))
                    assert not (at and start and x[at - 1] == w[start - 1])
                    assert not (at + length < len(x) and start + length < len(w) and x[at + length] == w[start + length])
                    hit |= set(range(start, start + length))
                assert len(set(found)) == len(found)
                assert (n, len(hit), sorted({str(i) for i, *_ in found})) == brute.leaks(t, items, 4)


def test_suffix_array():
    r = random.Random(6)
    for _ in range(100):
        numbers = np.array([r.randrange(0, 4) for _ in range(r.randrange(1, 80))])
        run = decontaminate.runs_of(numbers)
        at = np.flatnonzero(numbers)
        want = sorted(at.tolist(), key=lambda i: (numbers[i : i + run[i]].tolist(), i))
        assert decontaminate.suffix_array(numbers, run, at).tolist() == want


def test_language_id(spark, docs, empty):
    en = "the cat and the dog were in the house with all of their friends"
    de = "der hund und die katze waren mit allen ihren freunden in dem haus"
    taught = spark.createDataFrame([(i, (en, de)[i % 2], ("en", "de")[i % 2]) for i in range(60)] + [(60, "123", "en"), (61, None, "de"), (62, en, None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(taught).collect()}
    assert len(got) == 63 and all(got[i].lang_pred == ("en", "de")[i % 2] and 0 <= got[i].score <= 1 for i in range(60))
    assert got[60].lang_pred == got[61].lang_pred == "und" and got[62].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    model = language_id.Model(language_id.fit(taught.where("doc_id < 40")).toArrow())
    assert next(model.predict(["freundenhaus"]))[0] == "de"  # unseen: n-grams decide
    assert language_id.identify(docs).count() == docs.count() and language_id.identify(empty).count() == 0


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    x = language_id.identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    assert x.where("lang_pred = lang").count() >= 0.95 * x.count()


def test_language_model_beyond_a_broadcast(spark, docs, empty, monkeypatch):
    """A model that is joined, not broadcast, says the same of every text."""
    r, rows = random.Random(13), []
    for i in range(80):
        lang = "abc"[i % 3]
        rows.append((i, " ".join("".join(r.choice("xyz" + lang * 3) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 12))), lang))
    rows += [(90, "नमस्ते नमस्ते", "d"), (91, None, "a"), (92, "", "a"), (93, "12 34", "b"), (94, "नमस qqq", None), (3, rows[3][1], "a"), (None, "xx", None)]
    some = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for start in (some, docs, some.withColumn("lang", F.lit(None).cast("string")), empty):
        want = language_id.identify(start).collect()
        monkeypatch.setattr(language_id, "MODEL_ROWS", -1)
        got = language_id.identify(start).collect()
        monkeypatch.undo()
        key = lambda x: (x.doc_id is None, x.doc_id, x.lang_pred, x.score)
        assert len(got) == len(want)
        for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
            assert a[:3] == b[:3] and abs(a.score - b.score) < 1e-5


def test_urls(spark):
    r = random.Random(3)
    urls = [None, "", "nothing", "http://", "://org/", "HTTPS://WWW.Example.ORG/es/x?q", "http://example.org/en/12#a", "http://notexample.org/es/", "http://evil.net/x.example.org/es/", "http://a.com/fr/", "http://com/de/", "http://org", "http://é.org/ü/", "http://a.com:80/de/", "x" * 3000 + "://b.org/" + "y" * 5000]
    urls += ["http://" + "".join(r.choice(["a.", "org", "com", "example.org", "/", "es/", "fr/", "de/", "en/1", "?"]) for _ in range(6)) for _ in range(300)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), RULES).collect()
    for row in got:
        rest = urls[row.page_id].split("://", 1)[1] if "://" in (urls[row.page_id] or "") else ""
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = brute.fold(rest[:n]), rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [x for x in RULES if (host == x.name.split("/")[0] or host.endswith("." + x.name.split("/")[0])) and path.startswith("/" + x.name.split("/", 1)[1])]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, best.name if best else None, "block" if best and not best.allow else "allow")


def test_automaton_globs():
    import re

    globs = ["a?c", "*b", "**/x*", "a*b**c", "?" * 70, "*.org/**"]
    machine = url_filter.Automaton(globs)
    r = random.Random(1)
    urls = ["".join(r.choice("abcx/.org") for _ in range(r.randrange(0, 80))).encode() for _ in range(400)] + [b"z" * 70]
    hits = machine.match(urls)
    plain = [re.compile(re.escape(g).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", ".").encode(), re.S) for g in globs]
    assert all(bool(p.fullmatch(u)) == bool(hits[i, k]) for i, u in enumerate(urls) for k, p in enumerate(plain))


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", None), (1, 2, "assistant", "<\\|im_end|> \\ <|"), (2, 0, None, ""), (3, 1, "we\nird\\n<|", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (None, 0, "user", "n")]
    got = {r.conv_id: r for r in chat.chat_digest(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        text, loss = "".join(f"{a}\n{b}\n" for _, a, b in own), "".join(b for _, a, b in own if a == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.chat_digest(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_escape_round_trip():
    r = random.Random(2)
    for _ in range(2000):
        t = "".join(r.choice(["<", "|", "\\", "\n", "a", "<|im_end|>", "<|im_start|>"]) for _ in range(12))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t) and chat.unescape_role(chat.escape_role(t)) == t
    turns = [("user", "<|im_start|>"), ("assistant", "é<|")]
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns and [chat.unescape(text[a:b]) for a, b in spans] == ["é<|"]


def test_reply_trees(spark):
    r = random.Random(4)
    nodes = [(f"n{i:03d}", None if i in (0, 60) else f"n{r.randrange(max(0, i - 4), i) if i < 60 else r.randrange(60, i):03d}", r.choice([None, 1.0, 2.0]), "user", f"t{i}") for i in range(90)] + [("x", "y", 1.0, "user", "c"), ("y", "x", 1.0, "user", "c")]
    paths = chat.best_branches(spark.createDataFrame(nodes, "node string, parent string, score double, role string, text string"), 2).collect()
    up, score = {n[0]: n[1] for n in nodes}, {n[0]: n[2] or 0.0 for n in nodes}
    parents, want = set(up.values()), {}
    for leaf in (n[0] for n in nodes if n[0] not in parents):
        path = [leaf]
        while up[path[-1]]:
            path.append(up[path[-1]])
        want.setdefault(path[-1], []).append((-sum(score[x] for x in path), leaf, path[::-1]))
    best = {leaf: path for v in want.values() for _, leaf, path in sorted(v)[:2]}
    got = {}
    for p in paths:
        got.setdefault(p.leaf, []).append((p.pos, p.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == best


def test_token_counts(docs, rows, empty):
    lengths = token_counts.token_lengths(docs).collect()
    enc = token_counts._encoder(token_counts.TOKENIZER)
    have = [len(enc.encode_ordinary(r[1] or "")) for r in rows]
    assert sorted(r.n_tokens for r in lengths) == sorted(have)
    hist = token_counts.length_histogram(token_counts.token_lengths(docs))
    for r in hist.collect():
        assert r.n_docs == have.count(r.n_tokens) and r.docs_ge == sum(x >= r.n_tokens for x in have) and r.tokens_ge == sum(x for x in have if x >= r.n_tokens)
        assert r.docs_le == sum(x <= r.n_tokens for x in have) and r.truncated_tokens == sum(min(x, r.n_tokens) for x in have) and r.total_tokens == sum(have)
    cut = {r.max_tokens: (r.truncated_tokens, r.docs_cut) for r in token_counts.truncated_total(hist, [5, 200]).collect()}
    assert cut == {n: (sum(min(x, n) for x in have), sum(x > n for x in have)) for n in (5, 200)}
    assert token_counts.quantiles(hist, [0.5]).first().n_tokens == sorted(have)[(len(have) + 1) // 2 - 1]
    assert token_counts.length_histogram(token_counts.token_lengths(empty)).count() == 0


def language_counts(words, grams=()):
    """words {word: {lang: n}} and n-grams likewise, as the table that a model is made of."""
    rows = [(0, w, x, n) for w, by in dict(words).items() for x, n in by.items()] + [(len(g), g, x, n) for g, by in dict(grams).items() for x, n in by.items()]
    out = pd.DataFrame(rows, columns=["order", "text", "lang", "n"])
    columns = [pa.array(out["order"], pa.int32()), pa.array(language_id.hash_of(out["text"].tolist()), pa.int64()), pa.array(out["lang"], pa.string()), pa.array(out["n"], pa.int64())]
    return pa.table(columns, names=["order", "key", "lang", "n"])


def test_language_model_backs_off():
    words = {"bonjour": {"fr": 9}, "hello": {"en": 9}}
    grams = {"^bonj": {"fr": 5}, "ello$": {"en": 5}, "lo": {"en": 2, "fr": 1}, "o": {"en": 1, "fr": 2}}
    model = language_id.Model(language_counts(words, grams))
    lang = lambda t: next(model.predict([t]))[0]
    assert lang("Hello hello") == "en" and lang("BONJOUR") == "fr"
    # unseen words: the longest order with a known n-gram decides, shorter ones are not asked
    assert lang("bonjoxlo") == "fr" and lang("cello") == "en" and lang("xlo") == "en" and lang("xo") == "fr"
    # nothing known: all languages are as likely, the least name is taken
    assert list(model.predict(["zzz"])) == [("en", 0.5)]
    assert list(model.predict([None, "", "12 _ !", "hello"]))[:3] == [("und", 0.0)] * 3
    assert list(language_id.Model(language_counts({})).predict(["hello"])) == [("und", 0.0)]


def test_language_fit_and_predict_against_brute_force(spark, monkeypatch):
    """Every score from plain counts of the same words and n-grams, in chunks of any size."""
    from collections import Counter
    from math import exp, log

    monkeypatch.setattr(language_id, "CHARS", 60)
    r, taught = random.Random(12), []
    for i in range(60):
        lang = "abc"[i % 3]
        taught.append((i, " ".join("".join(r.choice("xyz" + lang * 3) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 12))), lang))
    taught += [(60, "नमस्ते नमस्ते दुनिया", "d"), (61, None, "a"), (62, "xx", None)]
    model = language_id.Model(language_id.fit(spark.createDataFrame(taught, "doc_id bigint, text string, lang string")).toArrow())
    by, langs = {n: {x: Counter() for x in "abcd"} for n in range(6)}, "abcd"
    for _, t, x in taught:
        if t and x:
            for w in t.split():
                by[0][x][w] += 1
                for n in language_id.ORDERS:
                    by[n][x].update(language_id.grams_of(w, n))
    kinds = {n: len({k for c in by[n].values() for k in c}) for n in by}
    size = {n: kinds[0] if n == 0 else sum(kinds[k] for k in language_id.ORDERS) for n in by}
    value = lambda n, x, k: log((by[n][x][k] + 0.5) / (1 + sum(by[n][x].values()) + 0.5 * size[n]))
    known = lambda n, k: any(by[n][x][k] for x in langs)

    def score(w):
        if known(0, w):
            return [value(0, x, w) for x in langs]
        for n in language_id.ORDERS:
            some = [g for g in language_id.grams_of(w, n) if known(n, g)]
            if some:
                return [sum(value(n, x, g) for g in some) / len(some) for x in langs]
        return [0.0] * 4

    texts = [t for _, t, _ in taught] + ["aaaa qqq", "नमस", "bxq ccc", "q " * 500 + "a"]
    got = [p for part in language_id._chunks(texts) for p in model.predict(part)]
    assert model.langs == list(langs) and len(got) == len(texts)
    for t, (lang, share) in zip(texts, got):
        if not t:
            assert (lang, share) == ("und", 0.0)
            continue
        sums = [sum(c) for c in zip(*[score(w) for w in t.split()])]
        odds = [exp(s - max(sums)) for s in sums]
        assert abs(max(odds) / sum(odds) - share) < 1e-4 and abs(odds[langs.index(lang)] - max(odds)) < 1e-4


def test_urls_empty_repeated_and_extra_columns(spark):
    schema = "page_id bigint, url string, host string, path string, rule string, at int"
    rows = [(1, "http://a.org/x", "h", "p", "r", 1)] * 2 + [(None, "http://b.com/de/", "h", "p", "r", 1)]
    got = url_filter.judge(spark.createDataFrame(rows, schema), RULES).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "a.org", "/x", "org/", "allow")] * 2 + [(None, "b.com", "/de/", "com/de/", "block")]))
    assert url_filter.judge(spark.createDataFrame([], schema), RULES).count() == 0


def test_chat_long_texts_and_extra_columns(spark):
    long = prose(40, 30_000)
    rows = [(1, 0, "user", long, "n", "f"), (1, 1, "assistant", long, "n", "f")]
    (got,) = chat.chat_digest(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node string, formatted string")).collect()
    assert got.n_turns == 2 and got.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_mixing_rows_without_ids(spark):
    """Null and repeated doc_ids with texts of their own are told apart by the texts: half a document from the target."""
    rows = [(None if i < 10 else 5, prose(200 + i, 10 + i % 3), f"s{i // 10}") for i in range(20)]
    by = {}
    for r in mixing.mix(mixing.sized(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))).collect():
        x = by.setdefault(r.source, [0, r.target])
        x[0] += r.copies * r["size"]
    assert len(by) == 2 and all(abs(taken - target) <= 6.0 + 1e-6 for taken, target in by.values())
