"""DuckDB SQL of the queries that SQL can express, from their definitions."""

from __future__ import annotations

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT i, j FROM common JOIN n p ON p.doc_id = i JOIN n q ON q.doc_id = j WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT i, j FROM link UNION ALL SELECT j, i FROM link),
reach(i, j) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.i, b.j FROM reach r JOIN both_ways b ON r.j = b.i),
comp AS (SELECT i AS doc_id, min(j) AS component_id FROM reach GROUP BY i)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN comp USING (doc_id)
"""

OP3 = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
v AS (SELECT page_id, html, list_transform(range(8), lambda k: list_reduce(list_transform(range(1, 6), lambda i:
        CAST(instr('0123456789abcdef', x[5 * k + i]) - 1 AS BIGINT)), lambda a, b: a * 16 + b)) AS vs FROM h),
d AS (SELECT page_id, html, array_to_string(list_transform(vs, lambda n: array_to_string(list_transform([32768, 1024, 32, 1], lambda m:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n // m) % 32 + 1 AS BIGINT), 1)), '')), '') AS digest FROM v),
r AS (SELECT html, max(page_id) AS first FROM d GROUP BY html)
SELECT page_id, CAST(strlen(d.html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN r ON d.html = r.html
"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, len(e) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS i, b.vec_id AS j FROM ok a JOIN ok b ON a.n = b.n AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(i, j) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.i, l.j FROM reach r JOIN link l ON r.j = l.i),
comp AS (SELECT i AS vec_id, min(j) AS component_id FROM reach GROUP BY i),
deg AS (SELECT i AS vec_id, count(*) AS n FROM link GROUP BY i)
SELECT v.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN deg ON deg.vec_id = v.vec_id
"""


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a VARCHAR expression; needs the CTE ``crc(t)``."""
    return (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            "lambda x: CAST(('0x' || x) AS BIGINT))), lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1])), CAST(4294967295 AS BIGINT))")


#: The table of ``crc32_sql``, built by its rule (reflected polynomial EDB88320).
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
                    CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS t)"""

OP11 = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, x, s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) AS pos
      FROM (SELECT conv_id, turn, coalesce(text, '') AS x, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s
            FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, crc),
l AS (SELECT c.*, least(h, coalesce(own, 0)) AS taken FROM c LEFT JOIN own ON own.conv_id = c.base),
r AS (SELECT l.conv_id, pos, x, s FROM l JOIN t ON t.conv_id = l.base AND t.pos <= l.h
      UNION ALL SELECT l.conv_id, pos - l.h + l.taken, x, s FROM l JOIN t ON t.conv_id = l.conv_id AND t.pos > l.h),
p AS (SELECT conv_id, pos AS d, strlen(x) AS w, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM own),
m AS (SELECT conv_id, d, w, sha256(k) AS k, lag(sha256(k)) OVER (PARTITION BY conv_id ORDER BY d) AS up,
             d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
node AS (SELECT d, k, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n,
                sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
         FROM m GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY d, up),
own_sums AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, (node.n - 1) * w AS saved FROM node LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k),
sums AS (SELECT a.d, a.k, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(v.saved) AS saved
         FROM own_sums v JOIN m a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY a.d, a.k)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, CAST(sums.leaves AS BIGINT) AS n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM own_sums v JOIN sums ON sums.d = v.d AND sums.k = v.k LEFT JOIN node up ON up.d = v.d - 1 AND up.k = v.up
"""

OP12 = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
             md5(coalesce(text, ''))[1:15] AS h FROM documents, crc),
s AS (SELECT *, row_number() OVER w - 1 AS r, sum(size) OVER w AS upto, sum(size) OVER () AS total FROM d
      WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CAST(((2 * upto - size) * 40) // (2 * total) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(r - min(r) OVER (PARTITION BY shard) AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard FROM p
"""


def _op10() -> str:
    from tessera.llm.secret_scan import BASE, OWNED

    kinds = (*BASE, OWNED)

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    marks = ", ".join(
        f"string_split(regexp_replace(t, '({quoted(before)})({quoted(value)})', chr(1) || '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1)) AS p{i}"
        for i, (_, before, value, _) in enumerate(kinds))
    spans = "\nUNION ALL\n".join(
        f"""SELECT doc_id, owner, {i} AS ord, '{kind}' AS kind, 3 * k AS pos, p{i} AS p, p{i}[3 * k] AS value
FROM (SELECT doc_id, owner, p{i}, unnest(range(1, (len(p{i}) - 1) // 3 + 1)) AS k FROM m) WHERE length(p{i}[3 * k]) >= {least}"""
        for i, (kind, _, _, least) in enumerate(kinds))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS owner, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
m AS (SELECT doc_id, owner, {marks} FROM d),
raw AS ({spans}),
sp AS (SELECT doc_id, owner, ord, kind, value, CAST(coalesce(list_sum(list_transform(p[1:pos - 2], lambda x: length(x))), 0) AS BIGINT) AS s,
              CAST(list_sum(list_transform(p[1:pos], lambda x: length(x))) AS BIGINT) AS e FROM raw),
base AS (SELECT * FROM sp WHERE ord < 3),
own AS (SELECT * FROM sp WHERE ord = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = sp.doc_id AND b.s < sp.e AND sp.s < b.e)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM own),
few AS (SELECT value FROM cand GROUP BY value HAVING count(DISTINCT owner) <= 2),
judged AS (SELECT c.*, f.value IS NOT NULL AS live FROM cand c LEFT JOIN few f ON f.value = c.value),
per AS (SELECT doc_id, count(CASE WHEN ord = 0 THEN 1 END) AS a, count(CASE WHEN ord = 1 THEN 1 END) AS b, count(CASE WHEN ord = 2 THEN 1 END) AS c,
               string_agg(CASE WHEN ord < 3 THEN kind || ':' || s || ':' || e END, ',' ORDER BY s, ord) AS base_text,
               string_agg(CASE WHEN ord < 3 OR live THEN kind || ':' || s || ':' || e END, ',' ORDER BY s, ord) AS all_text,
               count(CASE WHEN live THEN 1 END) AS n_live, count(CASE WHEN NOT live THEN 1 END) AS n_example FROM judged GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base_text, '')) AS base_sha256, coalesce(all_text, '') AS spans,
       CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example
FROM d LEFT JOIN per USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1, "op3_warc": OP3, "op4_embedding_dedup": OP4, "op10_secret_scan": _op10(),
            "op11_conversation_trie": OP11, "op12_sharding": OP12}
