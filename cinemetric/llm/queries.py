"""Registered queries of the operators: ``name -> (spark_fn, duckdb_sql | None)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superminhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


#: Whole pair-wise comparison; for small tables (the driver's oracle run).
OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[j] || ' ' || ws[j + 1] END AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS j FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT sh, count(*) AS c FROM s GROUP BY sh HAVING count(*) > 1),
o AS (SELECT s.doc_id, s.sh, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(f.c, 1), s.sh) AS r
      FROM s JOIN n USING (doc_id) LEFT JOIN f USING (sh)),
p AS (SELECT * FROM o WHERE r <= n - ((n * 4 + 4) // 5) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.sh = b.sh AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i AS (SELECT a, b, na, nb, count(*) AS k FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.sh = x.sh GROUP BY ALL),
e AS (SELECT a, b FROM i WHERE 100 * k >= 80 * (na + nb - k)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (WITH RECURSIVE r(d, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, g.b FROM r JOIN g ON g.a = r.x) SELECT d, min(x) AS m FROM r GROUP BY d)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, t.m AS component_id, d.doc_id = t.m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN t ON t.d = d.doc_id
"""

def op10_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixmerge import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"))


#: All 50-byte windows as hexadecimal strings, cut out of pieces of 1000 bytes.
OP10_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, k, substr(x, 2000 * k + 1, 2098) AS y, least(1000, length(x) // 2 - 49 - 1000 * k) AS n
      FROM (SELECT doc_id, x, unnest(range(0, (length(x) // 2) // 1000 + 1)) AS k FROM h)),
w AS (SELECT doc_id, 1000 * k + j AS i, substr(y, 2 * j + 1, 100) AS s FROM (SELECT doc_id, k, y, unnest(range(0, greatest(n, 0))) AS j FROM p)),
m AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.d < w.doc_id),
r AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM
      (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS b FROM hit)),
q AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, g),
c AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z0 FROM q),
k AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(x, 2 * z0 + 1, 2 * (a - z0)), '' ORDER BY a) AS head
      FROM c JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""

def op1_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .containment import contained_items
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, k, array_to_string(ws[j:j + k - 1], ' ') AS sh FROM
      (SELECT item_id, ws, least(5, len(ws)) AS k, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS j FROM b WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, k, array_to_string(ws[j:j + k - 1], ' ') AS sh FROM
      (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS j FROM w, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k)),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN i USING (k, sh) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / n AS containment FROM f JOIN n USING (item_id) WHERE n_found >= 0.8 * n - 1e-9
"""


def op3_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")) \
        .select("doc_id", "size", "source_size", "target", "taken")


#: The taken words by one running sum per source over the same hash order.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  CAST('0x' || substr(md5('1:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, source_size / weight AS r, 1.5 * sum(source_size) OVER () AS budget,
             coalesce(sum(2 * source_size) OVER o, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
      FROM w WINDOW o AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(budget - full_before AS DOUBLE) / weight_left AS level FROM f),
t AS (SELECT *, 2 * source_size <= level * weight AS stops FROM l),
g AS (SELECT source, source_size, CAST(CASE WHEN stops OR x IS NULL THEN 2 * source_size ELSE x * weight END AS DOUBLE) AS target
      FROM (SELECT *, (SELECT arg_min(level, r) FROM t WHERE NOT stops) AS x FROM t)),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS passes FROM g),
c AS (SELECT d.*, p.source_size, p.target, p.passes, CAST(round(p.target) AS BIGINT) - p.passes * p.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c
"""

def op2_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .factormachine import classify
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 0.5)


def op4_assignment_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import secret_spans
    return secret_spans(table(spark, sf_dir, "documents"))


def op6_subword_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .subwordbag import classify
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 0.7)


def op7_winnowed_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licensescan import licenses
    return licenses(table(spark, sf_dir, "documents"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenrollup import corpus_totals
    return corpus_totals(table(spark, sf_dir, "documents"), scratch_path(spark, "rollup"))


def op9_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prunedgraph import near_duplicate_vectors
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


#: All pairs of normalised vectors; for small tables (the driver's oracle run).
OP9_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
t AS (WITH RECURSIVE r(d, x) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.d, p.b FROM r JOIN p ON p.a = r.x) SELECT d, min(x) AS m FROM r GROUP BY d)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, t.m AS component_id, v.vec_id = t.m AS kept FROM v LEFT JOIN n ON n.a = v.vec_id JOIN t ON t.d = v.vec_id
"""

def op11_time_forward_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversationtrie import prefix_trie
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Prefixes as lists of turns; a node's subtree is found along its members' paths.
OP11_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT DISTINCT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
             xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, y:
                 list_reduce(list_concat([xor(c, y)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda z, k: xor(z >> 1, 3988292384 * (z & 1))))) % 6 AS h FROM b),
r AS (SELECT h.conv_id, pos AS o, role, text FROM h JOIN t ON t.conv_id = h.base AND pos <= h
      UNION ALL SELECT h.conv_id, 10 + pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND pos > h),
p AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY o) AS x FROM r GROUP BY conv_id),
q AS (SELECT conv_id, coalesce(x, []) AS x FROM h LEFT JOIN p USING (conv_id)),
n AS (SELECT conv_id, x, x[1:d] AS k, d FROM (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS d FROM q)),
v AS (SELECT d AS depth, k, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(CASE WHEN len(x) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM n GROUP BY d, k),
s AS (SELECT a.depth, a.k, u.conv_id, u.depth AS u_depth, (u.n_convs - 1) * CASE WHEN u.depth = 0 THEN 0 ELSE length(u.k[u.depth].text) END AS saved
      FROM v u JOIN n ON n.conv_id = u.conv_id AND n.d <= u.depth JOIN v a ON a.depth = n.d AND a.k = n.k),
e AS (SELECT u.depth - 1 AS depth, u.k[1:u.depth - 1] AS k, count(*) AS n_children FROM v u WHERE u.depth > 0 GROUP BY 1, 2),
g AS (SELECT s.depth, s.k, sum(saved) AS saved, count(*) FILTER (e.n_children IS NULL) AS n_leaves
      FROM s JOIN v u ON u.conv_id = s.conv_id AND u.depth = s.u_depth LEFT JOIN e ON e.depth = u.depth AND e.k = u.k GROUP BY 1, 2)
SELECT v.conv_id, v.depth, w.conv_id AS parent_conv_id, v.n_convs, coalesce(e.n_children, 0) AS n_children, g.n_leaves,
       CAST(g.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN g ON g.depth = v.depth AND g.k = v.k LEFT JOIN e ON e.depth = v.depth AND e.k = v.k
LEFT JOIN v w ON w.depth = v.depth - 1 AND w.k = v.k[1:v.depth - 1]
"""

def op12_rotated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rotatedclusters import cluster
    return cluster(table(spark, sf_dir, "embeddings"))


def _op12_sql(rounds: int = 10) -> str:
    """Every distance to every centroid, round after round."""
    near = """a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{r} m USING (i) GROUP BY vec_id, c)
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
    move = """c{s} AS MATERIALIZED (SELECT o.c, o.i, coalesce((t - ((t % n) + n) % n) // n, o.x) AS x FROM c{r} o
      LEFT JOIN (SELECT c, i, sum(x) AS t, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY c, i) USING (c, i))"""
    steps = [s for r in range(rounds + 1) for s in ([near.format(r=r)] + ([move.format(r=r, s=r + 1)] if r < rounds else []))]
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (SELECT vec_id, i, CAST(floor(1024 * e[i]) AS BIGINT) AS x FROM (SELECT vec_id, e, unnest(range(1, 65)) AS i FROM e WHERE len(list_filter(e, lambda y: isfinite(y))) = 64)),
k AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) QUALIFY c < 8),
c0 AS MATERIALIZED (SELECT c, i, x FROM k JOIN v USING (vec_id)),
{", ".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)
"""


def op13_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {
    "op13_family_svm": (op13_family_svm, None),
    "op12_rotated_clusters": (op12_rotated_clusters, _op12_sql()),
    "op11_time_forward_trie": (op11_time_forward_trie, OP11_SQL),
    "op2_factor_machine": (op2_factor_machine, None),
    "op4_assignment_lexing": (op4_assignment_lexing, None),
    "op6_subword_bag": (op6_subword_bag, None),
    "op7_winnowed_licenses": (op7_winnowed_licenses, None),
    "op8_token_rollup": (op8_token_rollup, None),
    "op9_pruned_graph": (op9_pruned_graph, OP9_SQL),
    "op1_minhash_containment": (op1_minhash_containment, OP1_SQL),
    "op3_splitting_tree": (op3_splitting_tree, OP3_SQL),
    "op5_superminhash": (op5_superminhash, OP5_SQL),
    "op10_suffix_merge": (op10_suffix_merge, OP10_SQL),
}
