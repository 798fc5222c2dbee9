"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm import bpe, divergence, ego, merkle, minhash, negatives, orc_tokens, packing, pii, quality, substrings, toxicity, urls
from verdikt.llm.common import Scratch, table, train_row


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op2_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    path = scratch.path("ids.orc")
    orc_tokens.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return orc_tokens.digests(spark, path)


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scores = quality.score(docs, model)
    return scores.select("doc_id", (~train_row(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.linked(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


def op7_ego_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.linked(table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scores = toxicity.score(docs, model)
    return scores.select("doc_id", (~train_row(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, Scratch(spark, "op10"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"), Scratch(spark, "op12"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 finds without deobfuscation, which SQL can say."""
    return pii.digests(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded to a table of ids and decoded from it."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path, public_tokenizers.PATTERN).select("doc_id", F.sha2("raw", 256).alias("decoded_sha256"))


def _op1_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in urls.RULES)
    terms = ", ".join(f"('{t}', {w})" for t, w in sorted(urls.WEIGHTS.items()))
    # Printable characters' escapes, the percent sign's last so that nothing is undone twice.
    escapes = ", ".join("'" + f"%{code:02x}{chr(code)}".lower().replace("'", "''") + "'" for code in [c for c in range(0x7E, 0x1F, -1) if c != 0x25] + [0x25])
    return f"""
WITH rules(verdict, host, path) AS (VALUES {rules}),
terms(term, weight) AS (VALUES {terms}),
rest AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS MATERIALIZED (SELECT page_id, list_reduce(list_prepend(translate(coalesce(url, ''), '{upper}', '{lower}'), [{escapes}]), lambda a, e: replace(a, e[1:3], e[4:4])) AS low,
  translate(regexp_extract(r, '^[^/?#]*'), '{upper}', '{lower}') AS host,
  regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
fits AS (SELECT p.page_id, r.verdict, r.host || r.path AS rule,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
found AS (SELECT t.page_id, list(t.term ORDER BY t.term) AS terms, sum(t.weight)::INTEGER AS weight
  FROM (SELECT p.page_id, p.low, t.term, t.weight FROM parts p JOIN terms t ON contains(p.low, t.term)) t
  WHERE regexp_matches(t.low, '(^|[^\\pL\\pN])' || t.term || '($|[^\\pL\\pN])') GROUP BY t.page_id)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN coalesce(w.weight, 0) >= {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(w.terms, []) AS terms, coalesce(w.weight, 0) AS weight
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1 LEFT JOIN found w ON w.page_id = p.page_id"""


def _pii_base_sql() -> str:
    """Matches and what stands between them give the places; RE2 patterns as the contract has them."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    each = " UNION ALL ".join(f"SELECT r, {k} AS kind, '{name}' AS name, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS gaps FROM t" for k, (name, p) in enumerate(patterns.items()))
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(patterns))
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({each}),
e AS (SELECT r, kind, name, unnest(found) AS s, unnest(gaps[1 : len(found)]) AS gap, generate_subscripts(found, 1) AS i FROM m WHERE len(found) > 0),
p AS (SELECT *, sum(length(gap) + length(s)) OVER (PARTITION BY r, kind ORDER BY i) AS stop, reverse(regexp_replace(s, '[^0-9]', '', 'g')) AS d FROM e),
ok AS (SELECT *, stop - length(s) AS start FROM p WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (ltrim(x, '0') <> '' AND right(ltrim(x, '0'), 3)::INTEGER > 255))) = 0
  WHEN 3 THEN length(d) BETWEEN 9 AND 15
  ELSE length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, i::INTEGER + 1, 1)::INTEGER ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(d, i::INTEGER + 1, 1)::INTEGER + 1] END)) % 10 = 0 END),
g AS (SELECT r, {counts}, string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans FROM ok GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in patterns)}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN g USING (r)"""


def _op4_sql() -> str:
    """The tree and its pieces, spelled out row by row. ``near`` holds pieces against pieces, not hashes of them."""
    piece = merkle.PIECE.replace("\\u", "\\x").replace("\\x3001\\x3002", "\\x{3001}\\x{3002}")
    for bound in ("5000", "50ff", "6000", "60ff", "7000", "70ff"):
        piece = piece.replace(f"\\x{bound}", f"\\x{{{bound}}}")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents),
pairs AS (SELECT d.doc_id, d.k, d.text AS a, left(d.text, length(d.text) - length(d.text) // 4) || left(e.text, length(d.text) // 4) AS b, e.text AS c
  FROM d JOIN d e ON e.k = d.k % d.n + 1),
texts AS (SELECT k, x, t FROM pairs, LATERAL (VALUES ('a', a), ('b', b), ('c', c)) v(x, t)),
lines AS (SELECT k, x, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM texts WHERE t <> ''),
leaves AS (SELECT *, sha256(line) AS leaf FROM lines),
numbered AS (SELECT *, coalesce(sum(CASE WHEN strpos('08192a3b4c5d6e7f', left(leaf, 1)) <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY k, x ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM leaves),
sections AS (SELECT k, x, s, sha256(string_agg(leaf, '' ORDER BY i)) AS node, string_agg(left(leaf, 16), '' ORDER BY i) AS short FROM numbered GROUP BY ALL),
prints AS (SELECT t.k, t.x, sha256(coalesce(p.nodes, '')) AS root, p.short, length(replace(t.t, chr(10), '')) AS size FROM texts t
  LEFT JOIN (SELECT k, x, string_agg(node, '' ORDER BY s) AS nodes, string_agg(left(node, 16) || ':' || short, '/' ORDER BY s) AS short FROM sections GROUP BY ALL) p USING (k, x)),
pieces AS (SELECT k, x, piece, count(*) * length(piece) AS n FROM (SELECT k, x, unnest(regexp_extract_all(line, '{piece}')) AS piece FROM leaves) GROUP BY k, x, piece),
shared AS (SELECT p.k, q.x AS pair, sum(least(p.n, q.n)) AS n FROM pieces p JOIN pieces q ON p.k = q.k AND p.piece = q.piece AND p.x = 'a' AND q.x <> 'a' GROUP BY ALL),
near AS (SELECT p.k, q.x AS pair, CASE WHEN p.root = q.root THEN 1.0 WHEN p.size + q.size = 0 THEN 0.0
  ELSE least((2 * coalesce(s.n, 0))::DOUBLE / (p.size + q.size), (p.size + q.size)::DOUBLE / (p.size + q.size + 1)) END::DOUBLE AS near
  FROM prints p JOIN prints q ON p.k = q.k AND p.x = 'a' AND q.x <> 'a' LEFT JOIN shared s ON s.k = p.k AND s.pair = q.x)
SELECT o.doc_id, length(o.a) AS n_chars, sha256(o.b) AS edited_sha256, concat_ws('/', p.root, p.short) AS fingerprint, concat_ws('/', q.root, q.short) AS edited_fingerprint, y.near AS near_edited, z.near AS near_next
FROM pairs o JOIN prints p ON p.k = o.k AND p.x = 'a' JOIN prints q ON q.k = o.k AND q.x = 'b' JOIN near y ON y.k = o.k AND y.pair = 'b' JOIN near z ON z.k = o.k AND z.pair = 'c'"""


def _op6_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - {minhash.SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {minhash.SHINGLE - 1}], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= {minhash.LIMIT} * (p.n + q.n - shared.n)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, s.b FROM reach r JOIN steps s ON s.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept FROM documents d JOIN least l USING (doc_id) LEFT JOIN sizes s USING (doc_id)"""


def _op7_sql() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.q > 0 AND b.q > 0
  WHERE list_inner_product(a.e, b.e) / sqrt(a.q) / sqrt(b.q) >= {ego.COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m USING (vec_id) LEFT JOIN counted c USING (vec_id)"""


def _op11_sql() -> str:
    n = substrings.WINDOW
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + {n - 1}], ' ') AS s FROM starts),
least AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN least USING (s) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p, true AS gone FROM hits),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
told AS (SELECT doc_id, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone IS NULL) AS kept FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(t.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM d LEFT JOIN told t USING (doc_id)"""


def _op12_sql() -> str:
    n = negatives
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({int(n.SCALE)} * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % {n.EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {n.POSITIVES})
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND {n.FLOOR} * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= {n.NEGATIVES}"""


def _op13_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sums.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source)),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v) AS q
  FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sides AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sides x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM s WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= {divergence.TOP}"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_orc_tokens": op2_orc_tokens,
    "op3_pii_spans": op3_pii_spans,
    "op4_merkle": op4_merkle,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_ego_embeddings": op7_ego_embeddings,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_toxicity": op9_toxicity,
    "op10_bm25_packing": op10_bm25_packing,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
    "pii_base": pii_base,
    "bpe_decoded": bpe_decoded,
}

ORACLES: dict[str, str] = {"op1_url_filter": _op1_sql(), "op4_merkle": _op4_sql(), "op6_minhash_dedup": _op6_sql(), "op7_ego_embeddings": _op7_sql(), "op11_substring_dedup": _op11_sql(), "op12_hard_negatives": _op12_sql(), "op13_source_divergence": _op13_sql(), "pii_base": _pii_base_sql(), "bpe_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"}
