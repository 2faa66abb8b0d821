"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from .licenses import GAP, HINT, RULES, SENTENCES, SPLIT

RABITQ = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""

MINHASH = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
u AS (SELECT doc_id, hash(unnest(s)) AS h FROM s), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l0 AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), l AS (SELECT a, b FROM l0 UNION SELECT b, a FROM l0),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.a = doc_id"""

WARC = """WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages), q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS target FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::INT >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
CASE WHEN page_id < target THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < target THEN target END AS refers_to FROM q"""

def _suffix() -> str:
    inner = lambda at: f"substr(hex(array_slice(b, {at}, {at})), 1, 1) IN ('8', '9', 'A', 'B')"
    start = "CASE " + " ".join(f"WHEN NOT {inner(f's.a - {k}')} THEN s.a - {k}" for k in range(3)) + " ELSE s.a - 3 END"
    end = "CASE " + " ".join(f"WHEN NOT {inner(f's.z + {k + 1}')} THEN s.z + {k}" for k in range(3)) + " ELSE s.z + 3 END"
    pieces = lambda name, spans: f"""{name}_f AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM {spans} UNION ALL SELECT doc_id, max(z) + 1, 1000000000000 FROM {spans} GROUP BY doc_id),
{name} AS (SELECT f.doc_id, unhex(string_agg(CASE WHEN f.a <= least(f.z, d.n) THEN hex(array_slice(b, f.a, least(f.z, d.n))) ELSE '' END, '' ORDER BY f.a)) AS left_over FROM {name}_f f JOIN d USING (doc_id) GROUP BY f.doc_id)"""  # noqa: E731
    return f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS h FROM d, range(1, n - 398) r(i)), rep AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), s AS (SELECT doc_id, i FROM w SEMI JOIN rep USING (h)),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s), k AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 399 AS z FROM k GROUP BY doc_id, k), wider AS (SELECT s.doc_id, {start} AS a, {end} AS z FROM spans s JOIN d USING (doc_id)),
{pieces("bytes", "spans")}, {pieces("chars", "wider")}, t AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(bytes.left_over, b)) AS kept_sha256, decode(coalesce(chars.left_over, b)) AS kept
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN bytes USING (doc_id) LEFT JOIN chars USING (doc_id)"""


def _licenses() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rules = []
    for number, (name, sequence) in enumerate(RULES):
        joins = "".join(f" JOIN ids x{k} ON x{k}.doc_id = x0.doc_id AND x{k}.id = '{i}' AND x{k}.place > x{k - 1}.place AND x{k}.place <= x{k - 1}.place + {1 + GAP}" for k, i in enumerate(sequence) if k)
        rules.append(f"SELECT DISTINCT x0.doc_id, {number} AS rule, '{name}' AS license FROM ids x0{joins} WHERE x0.id = '{sequence[0]}'")
    return f"""WITH known(s, id) AS (VALUES {known}), raw AS (SELECT doc_id, unnest(string_split_regex(text, '{SPLIT}')) AS s, generate_subscripts(string_split_regex(text, '{SPLIT}'), 1) AS place FROM documents),
ids AS (SELECT doc_id, place, id FROM raw JOIN known ON known.s = trim(regexp_replace(lower(raw.s), '[^a-z0-9]+', ' ', 'g')) WHERE regexp_matches(raw.s, '{HINT}')),
met AS ({" UNION ALL ".join(rules)}), first AS (SELECT doc_id, license, min(rule) AS rule FROM met GROUP BY 1, 2),
l AS (SELECT doc_id, string_agg(license, ' ' ORDER BY rule) AS licenses FROM first GROUP BY 1), i AS (SELECT doc_id, count(*) AS n, string_agg(id, ' ' ORDER BY place) AS ids FROM ids GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_license_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN i USING (doc_id) LEFT JOIN l USING (doc_id)"""


ORACLE_SQL = {
    "op1_rabitq_dedup": RABITQ,
    "op2_minhash_dedup": MINHASH,
    "op4_warc_index": WARC,
    "op9_license_scan": _licenses(),
    "op10_suffix_array_dedup": _suffix(),
}
