"""The queries ``opN_<name>`` of this subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import hard_negatives, hyperminhash, line_runs, multi_index, packing, pfair, pii, prefix_trie, secrets, token_counts, toxicity, warc, weighted_sampling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return pii.digest(_table(spark, sf_dir, "documents"))


QUERIES["op9_personal_data"] = op9_personal_data


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets.digest(_table(spark, sf_dir, "documents"))


QUERIES["op10_secrets"] = op10_secrets


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return token_counts.digest(_table(spark, sf_dir, "documents"))


QUERIES["op6_token_counts"] = op6_token_counts


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences."""
    return packing.digest(_table(spark, sf_dir, "documents"))


QUERIES["op5_packing"] = op5_packing


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all documents in the mix of their sources."""
    return pfair.digest(_table(spark, sf_dir, "documents"))


QUERIES["op8_pfair_mix"] = op8_pfair_mix


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return warc.derivatives(_table(spark, sf_dir, "pages"))


QUERIES["op7_warc_derivatives"] = op7_warc_derivatives


def op4_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edits."""
    return weighted_sampling.fingerprint_edits(_table(spark, sf_dir, "documents"))


QUERIES["op4_weighted_fingerprints"] = op4_weighted_fingerprints


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings."""
    return multi_index.digest(_table(spark, sf_dir, "embeddings"))


QUERIES["op1_multi_index"] = op1_multi_index


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents."""
    return hyperminhash.digest(_table(spark, sf_dir, "documents"))


QUERIES["op2_hyperminhash"] = op2_hyperminhash


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by a model of the labelled ones."""
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op3_toxicity"] = op3_toxicity


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.digest(_table(spark, sf_dir, "conversations"))


QUERIES["op11_prefix_trie"] = op11_prefix_trie


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, each kept in its smallest document."""
    return line_runs.digest(_table(spark, sf_dir, "documents"))


QUERIES["op12_line_runs"] = op12_line_runs


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor and positive among all embeddings."""
    return hard_negatives.digest(_table(spark, sf_dir, "embeddings"))


QUERIES["op13_hard_negatives"] = op13_hard_negatives


#: Links of vectors and, by rounds of smallest neighbours, their components.
ORACLE["op1_multi_index"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

#: Whole shingle sets, joined on shingles.
ORACLE["op2_hyperminhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || chr(1) || w[i + 1]) ELSE w END) AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT g.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(g.doc_id, coalesce(c.c, g.doc_id)) AS component_id, g.doc_id = least(g.doc_id, coalesce(c.c, g.doc_id)) AS kept
FROM g LEFT JOIN c ON c.a = g.doc_id"""


def _pfair_sql(weights: dict[str, int], rows: int) -> str:
    """Earliest deadlines first by a recursive step for each slot; blocks by the order of an MD5."""
    total = sum(weights.values())
    ws = ", ".join(f"({i}, '{n}', {w})" for i, (n, w) in enumerate(weights.items()))
    return f"""
WITH RECURSIVE src(no, source, w) AS (VALUES {ws}), names AS (SELECT list(w ORDER BY no) AS ws FROM src),
run(t, done, pick) AS (
  SELECT -1, list_transform(ws, lambda x: 0), -1 FROM names
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i - 1 = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT t, done, list_min(list_filter(list_transform(done, lambda d, i: CASE WHEN d < ws[i] AND floor(d * {total} / ws[i]) <= t + 1 THEN CAST(ceil((d + 1) * {total} / ws[i]) AS BIGINT) * 1000 + i - 1 END), lambda x: x IS NOT NULL)) % 1000 AS pick
    FROM run, names WHERE t + 1 < {total})),
plan AS (SELECT source, w, t AS slot, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS k FROM run JOIN src ON pick = no WHERE t >= 0),
g AS (SELECT doc_id, d.source, coalesce(src.source, '(other)') AS mix_group FROM documents d LEFT JOIN src ON d.source = src.source),
r AS (SELECT *, row_number() OVER (PARTITION BY mix_group ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS no FROM g)
SELECT doc_id, r.source, mix_group, no // {rows} AS block_no, (no // {rows} // w) * {total} + CAST(floor(k * {total} / w) AS BIGINT) AS release, (no // {rows} // w) * {total} + CAST(ceil((k + 1) * {total} / w) AS BIGINT) AS deadline,
  (no // {rows} // w) * {total} + slot AS slot, CAST(no % {rows} AS INTEGER) AS place
FROM r JOIN plan ON r.mix_group = plan.source AND (no // {rows}) % w = k"""


ORACLE["op8_pfair_mix"] = _pfair_sql({**pfair.WEIGHTS, pfair.OTHER: 1}, pfair.BLOCK_ROWS)

#: Paths as prefixes of arrays, members by prefix, sums over subtrees by a join on depth and prefix; CRC-32 bit by bit.
ORACLE["op11_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY p) AS own FROM t GROUP BY conv_id),
c AS (SELECT conv_id, own, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(CAST(a AS BIGINT), CAST(b AS BIGINT)), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)) AS crc FROM own),
h AS (SELECT conv_id, own, CAST(xor(CAST(crc AS BIGINT), 4294967295) % 4 AS BIGINT) AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
n AS (SELECT conv_id, d, md5(CAST(path[:d] AS VARCHAR) || '#' || d) AS k, CASE WHEN d > 0 THEN md5(CAST(path[:d - 1] AS VARCHAR) || '#' || (d - 1)) END AS up, len(path) = d AS ends,
  CASE WHEN d > 0 THEN len(list_filter(string_split_regex(path[d].t, '[ \t-\r]+'), lambda w: w <> '')) ELSE 0 END AS tokens FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM r)),
v AS (SELECT k, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(tokens) AS tokens, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM n GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT v.*, coalesce(kids.n, 0) AS n_children FROM v LEFT JOIN kids ON kids.k = v.k),
below AS (SELECT a.k, CAST(sum((w.n_convs - 1) * w.tokens) AS BIGINT) AS saved_tokens, CAST(count(*) FILTER (WHERE w.n_children = 0) AS BIGINT) AS n_leaves
  FROM (SELECT DISTINCT a.k, b.k AS k2 FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.d >= a.d) a JOIN w ON w.k = a.k2 GROUP BY a.k)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, below.n_leaves, below.saved_tokens, w.ends_sha256
FROM w JOIN below ON below.k = w.k LEFT JOIN v p ON p.k = w.up"""

#: The smallest document of each key.
ORACLE["op12_line_runs"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM o GROUP BY doc_id"""

#: Scores of all pairs.
ORACLE["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 10"""
