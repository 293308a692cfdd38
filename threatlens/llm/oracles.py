"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op2_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id NULLS FIRST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id NULLS FIRST) = 1 AS kept, text_sha256
FROM d"""

#: Kinds in their order: pattern, group whose length counts, least length.
_KINDS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
               r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["\']?\x20*[:=]\x20*["\']?"""
               r"""([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
}


def _secret_scan() -> str:
    parts = []
    for k, (kind, (pattern, group, least)) in enumerate(_KINDS.items()):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
SELECT doc_id, {k} AS k, '{kind}' AS kind, pos - n AS s, pos AS e FROM (
  SELECT doc_id, n, v, sum(g + n) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
    SELECT doc_id, unnest(range(len(m))) AS i, unnest(list_transform(m, lambda x: length(x))) AS n,
           unnest(list_transform(regexp_extract_all(t, {p}, {group}), lambda x: length(x))) AS v,
           unnest(list_transform(string_split_regex(t, {p})[:len(m)], lambda x: length(x))) AS g
    FROM (SELECT doc_id, t, regexp_extract_all(t, {p}) AS m FROM d))) WHERE v >= {least}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)})
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
       count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


ORACLES["op1_secret_scan"] = _secret_scan()

ORACLES["op6_exact_top_k"] = """
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.rid AS query_row, q.vec_id AS query_id, c.rid, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.rid <> q.rid),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS FIRST, rid)::INTEGER AS rank,
             vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5"""

ORACLES["op11_prefix_trie"] = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
                  struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn_, coalesce(text, '') AS txt
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
hex8 AS (SELECT c, n, c - c % 20 AS src, c::VARCHAR AS digits FROM n),
bits AS (SELECT c, n, src, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(digits) + 1),
           lambda i: ascii(substr(digits, i, 1))::BIGINT)), lambda a, b: (
           list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i:
             CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) AS crc FROM hex8),
plan AS (SELECT c, n, src, xor(crc, 4294967295::BIGINT) % 4 AS h,
                least(xor(crc, 4294967295::BIGINT) % 4, coalesce((SELECT s.n FROM n s WHERE s.c = b.src), 0)) AS m
         FROM bits b),
r AS (SELECT plan.c, t.p AS d, turn_, txt FROM plan JOIN t ON t.c = plan.src AND t.p <= m
      UNION ALL SELECT plan.c, m + t.p - h, turn_, txt FROM plan JOIN t ON t.c = plan.c AND t.p > h),
w AS (SELECT c, d, txt, sha256(string_agg(sha256(turn_.r) || sha256(turn_.t), '') OVER (PARTITION BY c ORDER BY d)) AS key,
             len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) AS words FROM r),
x AS (SELECT c, d, key, words FROM w UNION ALL SELECT c, 0, '', 0 FROM plan),
ends AS (SELECT c, max(d) AS e FROM x GROUP BY c),
node AS (SELECT d, key, min(x.c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                sha256(coalesce(string_agg(x.c::VARCHAR, ',' ORDER BY x.c) FILTER (e = d), '')) AS ends_sha256
         FROM x JOIN ends USING (c) GROUP BY d, key),
member AS (SELECT x.c, x.d, x.key, node.conv_id, node.n_convs, node.words FROM x JOIN node USING (d, key)),
edge AS (SELECT DISTINCT a.d, a.key, a.conv_id, b.conv_id AS parent FROM member a JOIN member b ON a.c = b.c AND a.d = b.d + 1),
kids AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n_children FROM edge GROUP BY 1, 2),
below AS (SELECT DISTINCT a.d, a.conv_id, b.d AS bd, b.conv_id AS bc, b.n_convs, b.words
          FROM member a JOIN member b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT below.d, below.conv_id, count(*) FILTER (kids.n_children IS NULL) AS n_leaves,
                sum((n_convs - 1) * words)::BIGINT AS saved_tokens
         FROM below LEFT JOIN kids ON kids.d = bd AND kids.conv_id = bc GROUP BY 1, 2)
SELECT node.conv_id, node.d::BIGINT AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens, ends_sha256
FROM node JOIN sums USING (d, conv_id) LEFT JOIN kids USING (d, conv_id) LEFT JOIN edge USING (d, conv_id)"""

ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || x[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || x[9:16])::BIGINT % (len(u) + 1) AS b,
             ('0x' || x[17:24])::BIGINT % 100 AS h3, ('0x' || x[25:32])::BIGINT % 100 AS h4 FROM d),
p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100
               THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
             coalesce(array_to_string(u[:least(a, b)], ''), '') AS pre,
             coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS mid,
             coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS suf FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""
