"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, chunks, decontaminate, htmltree, langid, licenses, mixing, neardup, phrases, prefixtrie, quality, secrets, topk
from fieldloom.llm.common import table


def vocabulary() -> str:
    """The tokenizer file; the vocabulary stays where its package has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans with one ledger: of the part of the corpus that was there before (one blob in eight), then of
    all of it. The second one passes over every pair of blob and rule version that the first has seen."""
    docs = table(spark, sf_dir, "documents")
    before = docs.where(F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 1), 16, 10).cast("int") < 2)
    ledger = secrets.extend(before.select("text"), None, secrets.RULES)
    return secrets.digest(secrets.scan(docs, ledger))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op4_html_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.extract(table(spark, sf_dir, "pages"))


def op5_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a table's posteriors don't allow the targets, the nearest mixture, and ``residual`` says how far off it is."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), slack=None)
    return mixed.select("doc_id", "n_tokens", *[F.round(f"q_{k}", 6).alias(f"q_{k}") for k in mixing.TARGETS], F.round("rate", 6).alias("rate"), F.round("residual", 6).alias("residual"))


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op9_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated(table(spark, sf_dir, "documents")).drop("cut")


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


def op12_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_ledger, op2_language_id, op3_byte_bpe, op4_html_style_tree, op5_quality_ratio,
        op6_license_rules, op7_mixing, op8_circulant_minhash, op9_gear_chunks, op10_pivot_topk, op11_prefix_trie, op12_phrase_tries, op13_ngram_decontamination,
    )
}


def _secret_rule_sql(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    if pattern == r"[0-9a-f]+":  # runs that are too short hold no other match
        pattern = r"[0-9a-f]{%d,}" % least
    p = pattern.replace("'", "''")
    return f"""
SELECT row, '{kind}' AS kind, {order} AS ord, s AS start, s + length(m) AS stop FROM (
  SELECT row, ms[i] AS m, gs[i] AS g,
         CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT row, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT row, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, string_split_regex(t, '{p}') AS ps FROM d)))
WHERE length(g) >= {least}"""


_BASE = ", ".join(f"'{k}'" for k in secrets.BASE_KINDS)
SECRETS_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + "\nUNION ALL".join(_secret_rule_sql(i, k, *r) for i, (k, r) in enumerate(secrets.RULES.items()))
    + f"""),
a AS (SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind IN ({_BASE})) AS base,
             """
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE_KINDS)
    + """ FROM f GROUP BY row)
SELECT doc_id, """
    + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE_KINDS)
    + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)"
)

NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, k.component_id = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN k ON k.a = w.doc_id
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: The unsigned CRC-32 of a number's decimal digits, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda z: z)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

TRIE_SQL = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS k, d, w FROM (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
t AS (SELECT c.conv_id, 0 AS part, k, d, w FROM c JOIN o ON o.conv_id = c.base AND k < h UNION ALL SELECT c.conv_id, 1, k, d, w FROM c JOIN o ON o.conv_id = c.conv_id AND k >= h),
s AS (SELECT c.conv_id, coalesce(list(t.d ORDER BY part, k) FILTER (t.d IS NOT NULL), []) AS l, coalesce(list(t.w ORDER BY part, k) FILTER (t.d IS NOT NULL), []) AS w FROM c LEFT JOIN t ON t.conv_id = c.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, depth, sha256(array_to_string(l[1:depth], ',')) AS key, CASE WHEN depth > 0 THEN sha256(array_to_string(l[1:depth - 1], ',')) END AS up, CASE WHEN depth > 0 THEN w[depth] ELSE 0 END AS w, depth = len(l) AS stops, l FROM (SELECT *, unnest(range(len(l) + 1)) AS depth FROM s)),
n AS (SELECT depth, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, arg_min(l, conv_id) AS l, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends FROM m GROUP BY depth, key),
k AS (SELECT up, depth - 1 AS depth, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY ALL),
a AS (SELECT *, coalesce(kids, 0) = 0 AS leaf FROM n LEFT JOIN (SELECT up AS key, depth, kids FROM k) USING (key, depth)),
b AS (SELECT depth, key, sum(leaf::INT)::BIGINT AS leaves, sum((n - 1) * w)::BIGINT AS saved FROM (SELECT x AS depth, sha256(array_to_string(l[1:x], ',')) AS key, leaf, n, w FROM (SELECT *, unnest(range(depth + 1)) AS x FROM a)) GROUP BY ALL)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(a.kids, 0) AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, a.ends AS ends_sha256
FROM a JOIN b ON b.key = a.key AND b.depth = a.depth LEFT JOIN n p ON p.key = a.up AND p.depth = a.depth - 1
"""

PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, 1 AS k, unnest(ws) AS ph FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w WHERE len(ws) > 2),
f AS MATERIALIZED (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, ph, string_split(ph, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT lang, ph, a, i, array_to_string(ws[1:i], ' ') AS lp, array_to_string(ws[i + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
x AS (SELECT u.*, l.f AS l, r.f AS r, (1000000::HUGEINT * u.a * u.a) // (l.f::HUGEINT * r.f) AS score FROM u JOIN f l ON l.lang = u.lang AND l.ph = u.lp JOIN f r ON r.lang = u.lang AND r.ph = u.rp),
s AS (SELECT lang, ph, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, i) AS z FROM x) WHERE z = 1),
hide AS (SELECT lang, part AS ph, max(a) AS a FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT s.lang, s.ph AS phrase, s.a, s.l, s.r, n.n, s.score::BIGINT AS score FROM s JOIN n ON n.lang = s.lang LEFT JOIN hide h ON h.lang = s.lang AND h.ph = s.ph WHERE h.a IS NULL OR 100 * h.a < 50 * s.a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM k WHERE rank <= 2000
"""

LEAKS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS words FROM (SELECT *, least(len(ws), 10) AS m FROM b WHERE len(ws) > 0 AND item_id IS NOT NULL)),
a AS (SELECT row, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: {'pos': i, 'words': ws[i:i + m - 1]})) AS x FROM d, (SELECT DISTINCT m FROM w) WHERE len(ws) >= m),
h AS (SELECT a.row, a.m, a.x.pos AS pos, w.item_id FROM a JOIN w ON w.m = a.m AND w.words = a.x.words),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(pos, pos + m)) AS p FROM h) GROUP BY row),
i AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h) GROUP BY row)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN i USING (row)
"""

ORACLE_SQL: dict[str, str] = {"op1_secret_ledger": SECRETS_SQL, "op8_circulant_minhash": NEARDUP_SQL, "op10_pivot_topk": TOPK_SQL, "op11_prefix_trie": TRIE_SQL, "op12_phrase_tries": PHRASES_SQL, "op13_ngram_decontamination": LEAKS_SQL}
