"""The operators' queries by name, and their SQL."""

from __future__ import annotations

from . import op1_token_counts, op2_quotes, op3_minhash, op4_language, op5_bpe, op6_pii, op7_packing, op8_embeddings, op9_toxicity, op10_media

QUERIES = {
    "op1_token_counts": op1_token_counts.query,
    "op2_quotation_linking": op2_quotes.query,
    "op3_minhash": op3_minhash.query,
    "op4_language": op4_language.query,
    "op5_bpe": op5_bpe.query,
    "op6_pii": op6_pii.query,
    "op7_packing": op7_packing.query,
    "op8_embeddings": op8_embeddings.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_media": op10_media.query,
}


def part_of(name: str, *columns: str):
    """A query's columns that SQL can express, as a query of their own."""
    return lambda spark, sf_dir: QUERIES[name](spark, sf_dir).select(*columns)


#: Parts of queries whose other columns are beyond SQL.
PARTS = {
    "pii_base_spans": part_of("op6_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
    "media_payloads": part_of("op10_media", "doc_id", "n_bytes", "payload_bytes", "payload_sha256"),
    "token_bytes": part_of("op1_token_counts", "doc_id", "n_bytes"),
}
QUERIES |= PARTS


def _base_spans() -> str:
    """Spans by extracting the matches and measuring what lies between them."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({digits})[i] AS INT) WHEN CAST(reverse({digits})[i] AS INT) > 4 THEN 2 * CAST(reverse({digits})[i] AS INT) - 9 ELSE 2 * CAST(reverse({digits})[i] AS INT) END)) % 10 = 0"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: NOT (length(ltrim(x, '0')) < 3 OR length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255'))) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
    }
    found = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {n} AS ord, m, s FROM (SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs FROM d))) WHERE {ok}" for n, (k, (p, ok)) in enumerate(kinds.items()))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
    g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)}, string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY ord, s) AS spans FROM f GROUP BY doc_id)
    SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


#: Encoders, trees, models and files are beyond SQL; tests hold those queries
#: against brute force, round trips and held-out accuracy instead. op3 and op8
#: compare every pair, which small tables allow. op2's SQL holds for tables in which
#: no line is quoted, as in the test tables; tests/llm has a brute force for quotes.
ORACLE_SQL: dict[str, str] = {
    "pii_base_spans": _base_spans(),
    "media_payloads": """SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(t || repeat(chr(0), CAST(p - n AS INTEGER))) AS payload_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, CAST(greatest(64, (strlen(coalesce(text, '')) + 63) // 64 * 64) AS BIGINT) AS p FROM documents)""",
    "token_bytes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
    "op2_quotation_linking": r"""WITH m AS (SELECT conv_id, turn, role, trim(array_to_string(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), lambda x: regexp_replace(x, '^ ', '')), chr(10)), ' ') AS body FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    t AS (SELECT conv_id, turn, lag(turn) OVER w AS parent_turn, first(turn) OVER w AS thread_turn, row_number() OVER w - 1 AS depth FROM (SELECT DISTINCT conv_id, turn FROM m) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT m.conv_id, m.turn, role, body, 0 AS n_quotes, 0 AS n_linked, 0 AS quote_depth, parent_turn, CAST(NULL AS BIGINT) AS linked_conv_id, CAST(NULL AS BIGINT) AS linked_turn, thread_turn, depth, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn, role, body) - 1 AS place FROM m JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn""",
    "op3_minhash": r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS ss FROM w),
    one AS MATERIALIZED (SELECT doc_id, unnest(ss) AS x FROM s),
    e AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS i FROM one l JOIN one r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY ALL) p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b WHERE 100 * i >= 85 * (len(sa.ss) + len(sb.ss) - i)),
    sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT sym.b, reach.label FROM reach JOIN sym ON reach.node = sym.a)
    SELECT s.doc_id, CAST(len(s.ss) AS BIGINT) AS n_shingles, r.label AS component_id, s.doc_id = r.label AS kept FROM s JOIN (SELECT node, min(label) AS label FROM reach GROUP BY node) r ON r.node = s.doc_id""",
    "op8_embeddings": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    g AS MATERIALIZED (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE x IS NOT NULL AND label IS NOT NULL AND NOT list_contains(list_transform(x, lambda c: c IS NULL OR NOT isfinite(c)), true)),
    e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / a.n / b.n >= 0.93),
    reach AS (SELECT vec_id AS node, vec_id AS label FROM v UNION SELECT e.b, reach.label FROM reach JOIN e ON reach.node = e.a)
    SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, r.label AS component_id, v.vec_id = r.label AS kept FROM v JOIN (SELECT node, min(label) AS label FROM reach GROUP BY node) r ON r.node = v.vec_id""",
}
