"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tideway.llm import conversations, embeddings, importance, mixing, packing, quality, secrets, simhash, spotsigs, substrings, token_files, toxicity, warc
from tideway.llm.common import read


def op1_spot_signatures(spark, sf_dir):
    return spotsigs.compare_with_next(read(spark, sf_dir, "documents"))


def op2_token_files(spark, sf_dir):
    return token_files.round_trip(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return substrings.digest(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    return secrets.digest(read(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_simhash(spark, sf_dir):
    return simhash.digest(read(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_quality(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_mixing(spark, sf_dir):
    return mixing.taken(read(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.packed(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversations.digest(read(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark, sf_dir):
    return importance.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_warc(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


def spot_signature_pairs(spark, sf_dir):
    return spotsigs.near_documents(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_spot_signatures, op2_token_files, op3_substring_dedup, op4_secret_scan, op5_embedding_near_dedup, op6_simhash, op7_toxicity, op8_quality, op9_mixing, op10_packing, op11_conversation_repair, op12_importance_resampling, op13_warc, spot_signature_pairs)}


SUBSTRINGS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS first_doc FROM p GROUP BY win),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f USING (win) WHERE first_doc < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
k AS (SELECT x.doc_id, count(r.j) AS n_removed, string_agg(word, ' ' ORDER BY x.j) FILTER (r.j IS NULL) AS kept FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.j = x.j GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
r AS (SELECT vec_id AS n, vec_id AS root FROM v UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.n)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, m.root AS component_id, v.vec_id = m.root AS kept FROM v JOIN (SELECT n, min(root) AS root FROM r GROUP BY n) m ON m.n = v.vec_id
"""


#: CRC-32 by a table that its rule makes; {crc} of a string x, beside the relation tab.
CRC_TABLE = "tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def crc_sql(x: str) -> str:
    """CRC-32 of the UTF-8 bytes of x, unsigned."""
    data = f"list_transform(range(1, 1 + 2 * octet_length(encode({x})), 2), lambda i: CAST('0x' || substr(hex(encode({x})), i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _way(x: str, cost: str, edit: str) -> str:
    """The element x, nine digits of cost and an audit, with one more edit."""
    return f"lpad(CAST(CAST(left({x}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{edit}'"


_INSERTED = f"b, s, least(u, {_way('b', '2', 'I')}, {_way('s', '2', 'I')}, {_way('a', '2', 'I')}) AS u, least(a, {_way('u', '2', 'I')}, {_way('b', '4', 'II')}, {_way('s', '4', 'II')}) AS a"


def _kept(initial: str, x: str) -> str:
    return f"CASE WHEN stays AND ini = '{initial}' THEN {_way(x, 'more', 'K')} END"


def _renamed(x: str) -> str:
    return f"CASE WHEN stays THEN {_way(x, '(2 + more)', 'R')} END"


CONVERSATIONS_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations),
c AS (SELECT k.*, {crc_sql("x")} % 20 AS code FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS nth FROM c WHERE code <> 0),
o AS (SELECT *, left(role, 1) AS ini, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS earlier, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, nth) AS seen FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'n' END AS fault, fault IN ('t', 'n') AS stays, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS more FROM o),
ids AS (SELECT DISTINCT conv_id FROM conversations),
r AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS b, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM ids
  UNION ALL
  SELECT conv_id, i, {_way("b", "3", "D")}, least({_way("s", "3", "D")}, {_kept("s", "b")}), least({_way("u", "3", "D")}, {", ".join(f(x) for x in "bsa" for f in (_renamed, lambda x: _kept("u", x)))}), least({_way("a", "3", "D")}, {_renamed("u")}, {_kept("a", "u")})
  FROM (SELECT r.conv_id, f.i, ini, stays, more, {_INSERTED} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1)
),
w AS (SELECT conv_id, least(b, a) AS way FROM (SELECT conv_id, {_INSERTED} FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))),
e AS (SELECT conv_id, substr(way, 10) AS audit, unnest(range(1, len(way) - 8)) AS p FROM w),
g AS (SELECT conv_id, p, audit[p] AS op, count(*) FILTER (audit[p] <> 'I') OVER v AS i, count(*) FILTER (audit[p] <> 'D') OVER v AS q FROM e WINDOW v AS (PARTITION BY conv_id ORDER BY p)),
h AS (SELECT g.conv_id, p, op, q, role, text, max(CASE WHEN q = 1 AND op = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g.conv_id) AS sys FROM g LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i AND op <> 'I'),
l AS (SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role ELSE CASE WHEN (q - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM h WHERE op <> 'D' GROUP BY conv_id),
n AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (earlier || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(left(way, 9) AS BIGINT) AS cost, substr(way, 10) AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM w LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM w.conv_id
"""

IMPORTANCE_SQL = rf"""
WITH {CRC_TABLE},
x AS (SELECT true AS own, doc_id AS id, text FROM documents UNION ALL SELECT false, CAST(item_id AS BIGINT), text FROM benchmark),
w AS (SELECT own, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
f AS (SELECT own, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gram FROM w),
d AS (SELECT gram, {crc_sql("gram")} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM f), tab),
n AS (SELECT bucket, CAST(count(*) FILTER (own) AS DOUBLE) AS s, CAST(count(*) FILTER (NOT own) AS DOUBLE) AS t FROM f JOIN d USING (gram) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS gain FROM n),
v AS (SELECT id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN d USING (gram) JOIN g USING (bucket) WHERE own GROUP BY id),
s AS (SELECT w.id AS doc_id, len(ws) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || w.id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN v ON v.id = w.id WHERE own),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS nth, count(*) OVER (PARTITION BY able) AS many FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND nth <= 25 * many // 100 THEN nth END AS rank FROM r
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4)) & 31 AS BIGINT) + 1, 1)) AS letters FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, list_aggregate(letters, 'string_agg', '') AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b
"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express."""
    return {
        "op3_substring_dedup": SUBSTRINGS_SQL, "op5_embedding_near_dedup": EMBEDDINGS_SQL, "op11_conversation_repair": CONVERSATIONS_SQL, "op12_importance_resampling": IMPORTANCE_SQL, "op13_warc": WARC_SQL,
    }
