"""The operators' queries over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import chat, decontaminate, divergence, embedding_dedup, exact_dedup, language_id, line_dedup, mixing, near_dedup, sharding, token_counts, url_filter, whitening
from lumenfold.llm.common import table

RULES = [url_filter.Rule("org/", True), url_filter.Rule("example.org/es/", False), url_filter.Rule("example.org/en/1", False), url_filter.Rule("com/fr/", True), url_filter.Rule("com/de/", False)]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.chat_digest(rows.union(extra))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return near.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)
    return near.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_chat_formatting, op3_url_filters, op4_mix_sources, op5_language_id, op6_decontamination, op7_sharding, op8_near_dedup, op9_exact_dedup, op10_token_counts, op11_source_divergence, op12_embedding_dedup, op13_whitening)
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
said AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'))
      + length(regexp_extract_all(role, '<\\\\*\\|')) + 1 + length(text) + length(regexp_extract_all(text, '<\\\\*\\|'))
      + length('<|im_end|>') + 1) AS formatted_chars
  FROM rows_ GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  cast(formatted_chars AS BIGINT) AS formatted_chars FROM said"""

_OP3 = """
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rule, rhost, rpath, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS n
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1"""

_OP4 = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    ('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0 * source_size AS most,
    list_extract([3.0, 1.0, 2.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)::DOUBLE AS weight FROM s),
f AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_,
    sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (1.5 * total - full_) / open_ AS level FROM f),
t AS (SELECT source, source_size, least(most, weight * coalesce((SELECT arg_min(level, most / weight) FROM l WHERE level * weight <= most), 1e300)) AS target FROM l),
g AS (SELECT *, CASE WHEN target >= source_size AND source_size > 0 THEN 1 ELSE 0 END AS base,
    CASE WHEN target >= source_size AND source_size > 0 THEN target - source_size ELSE target END AS goal FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.base, g.goal,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS here
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (size * CASE WHEN source_size = 0 THEN 0 ELSE base + CASE WHEN upto - here <= goal AND abs(upto - goal) < abs(goal - (upto - here)) OR upto <= goal THEN 1 ELSE 0 END END)::BIGINT AS taken FROM c"""

_OP9 = f"""
WITH d AS (SELECT doc_id, {_FOLD} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM d"""

_OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(cast(item_id AS VARCHAR), '') AS item, w, least(10, len(w)) AS n
  FROM (SELECT item_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
windows_ AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM b, unnest(range(1, len(w) - n + 2)) t(i)),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM b), unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT r, i, n, item FROM grams JOIN windows_ USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

# every pair that shares a shingle, on distinct shingle sets; a document's component by its links' closure
_OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM d),
g AS (SELECT md5(array_to_string(s, chr(10))) AS g, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT g, len(s) AS n, unnest(s) AS x FROM g),
links AS (SELECT a.g AS a, b.g AS b FROM e a JOIN e b ON a.x = b.x AND a.g <> b.g GROUP BY a.g, b.g, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT g, g FROM g UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
ids AS (SELECT md5(array_to_string(s, chr(10))) AS g, min(doc_id) AS least FROM s WHERE len(s) > 0 GROUP BY 1),
comp AS (SELECT a AS g, min(least) AS component FROM reach JOIN ids ON b = g GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component END AS component_id,
  CASE WHEN len(s) = 0 THEN true ELSE doc_id = component END AS kept
FROM s LEFT JOIN comp ON comp.g = md5(array_to_string(s, chr(10)))"""

_OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p, 1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (v.total + v.v) AS q
  FROM t JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200"""

_OP12 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings),
u AS (SELECT r, vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT x.a, l.b FROM reach x JOIN links l ON x.b = l.a),
c AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN v ON b = r GROUP BY a),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)"""

ORACLE_SQL: dict[str, str] = {"op11_source_divergence": _OP11, "op12_embedding_dedup": _OP12, "op6_decontamination": _OP6, "op8_near_dedup": _OP8, "op2_chat_formatting": _OP2, "op3_url_filters": _OP3, "op4_mix_sources": _OP4, "op9_exact_dedup": _OP9}
