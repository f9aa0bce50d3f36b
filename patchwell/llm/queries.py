"""One thin query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, language_id, language_model, ngram_join, packing, pii, quality, repair, tokenfile, trie, vectors, warc
from .scratch import crc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through ARC and WARC files and back, a row each. A null page is empty; repeated rows each stay; a null id is the smallest; no rows give no rows."""
    return warc.round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a benchmark window. Null and empty texts have no words and are clean; repeated rows each stay; without items all are clean."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document. Null and empty texts are scored by their statistics, which are zeros; rows without a usable label teach nothing."""
    measured = quality.measure(_read(spark, sf_dir, "documents"))
    held = F.pmod(crc("doc_id"), F.lit(5)) == 0
    model = quality.fit(measured, _read(spark, sf_dir, "labels").filter(~held))
    return quality.score(measured, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes. Null and empty texts have no shingles and are alone; repeated rows each stay."""
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences. Null and empty texts are their end id; repeated rows are documents of their own."""
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), words=1_000_000)


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of each document. Null and empty texts are one end token; repeated rows each count."""
    docs = _read(spark, sf_dir, "documents")
    held = F.pmod(crc("doc_id"), F.lit(5)) == 1
    out, model = language_model.score(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.words.n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token files and back, in order of ids (nulls first). Null and empty texts are their end id; repeated rows each stay."""
    return tokenfile.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole texts. Null texts and texts without a letter are und; rows without a language teach nothing."""
    docs = _read(spark, sf_dir, "documents")
    held = F.pmod(crc("doc_id"), F.lit(4)) == 2
    model = language_id.fit(docs.filter(~held).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth vector. Null, zero and non-finite vectors take no part; ties go to the smaller id."""
    return vectors.search(_read(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in whole texts. Null and empty texts have none; repeated rows each stay."""
    out = pii.find(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole documents and of their edited texts; nulls, ties and empties as ``fingerprint.fingerprints`` says."""
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations with their faults and the cheapest repair; nulls, ties and empties as ``repair.repair`` says."""
    return repair.repair(_read(spark, sf_dir, "conversations"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations; nulls, ties and empties as ``trie.prefix_trie`` says."""
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontaminate, op3_quality, op4_ngram_join, op5_packing, op6_katz, op7_token_file, op8_language_id, op9_nearest, op10_pii, op11_fingerprint, op12_repair, op13_trie)}

#: Words as the contracts cut them, A-Z lowered and no other letter.
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _crc_sql(s: str) -> str:
    """CRC-32 of a string of ASCII characters, bit by bit."""
    bit = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {bit}), 4294967295)"


#: DuckDB SQL for the queries that it can express.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(flatten(list_transform(range(8), lambda i: list_transform(range(4), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) >> (15 - 5 * k)) & 31) + 1 AS INT), 1)))), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM h""",
    "op2_decontaminate": rf"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT doc_id, item, k, p FROM places JOIN windows USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, k, p FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op4_ngram_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = words.doc_id) AS component_id FROM words LEFT JOIN sizes USING (doc_id)""",
    "op12_repair": rf"""
WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM hurt),
judged AS (SELECT *, left(role, 1) AS first, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(body, 1) NOT IN ('.', '!', '?') AS cut FROM placed),
r AS (SELECT *, blank OR again AS must, cut AND NOT blank AND NOT again AS short FROM judged),
edits(q, letter, role, q2, cost) AS (SELECT q, 'D', CAST(NULL AS VARCHAR), q, 2 FROM range(4) t(q) UNION ALL VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
  (0, 'R', NULL, 2, 1), (1, 'R', NULL, 2, 1), (2, 'R', NULL, 3, 1), (3, 'R', NULL, 2, 1)),
put(q, m, q2) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
sizes AS (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id),
best AS (SELECT conv_id, 0::BIGINT AS i, q2 AS q, printf('%09d', 5 * m) || repeat('I', m) AS way FROM sizes, put WHERE q = 0
  UNION ALL SELECT * FROM (SELECT b.conv_id, b.i + 1 AS i, p.q2 AS q, min(printf('%09d', CAST(left(b.way, 9) AS BIGINT) + e.cost + CASE WHEN e.letter <> 'D' AND r.short THEN 5 ELSE 0 END + 5 * p.m) || substr(b.way, 10) || e.letter || repeat('I', p.m)) AS way
    FROM best b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 JOIN edits e ON e.q = b.q AND (e.letter = 'D' OR (NOT r.must AND coalesce(e.role = r.first, true))) JOIN put p ON p.q = e.q2 GROUP BY ALL)),
won AS (SELECT b.conv_id, min(way) AS way FROM best b JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = s.n WHERE q IN (0, 3) GROUP BY ALL),
letters AS (SELECT conv_id, p, substr(way, 9 + p, 1) AS letter FROM (SELECT *, unnest(range(1, length(way) - 8)) AS p FROM won)),
steps AS (SELECT *, sum(CASE letter WHEN 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE letter WHEN 'D' THEN 0 ELSE 1 END) OVER w AS k, sum(CASE letter WHEN 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id) AS n FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
fixed AS (SELECT s.conv_id, string_agg(CASE letter WHEN 'K' THEN r.role ELSE CASE (k - n % 2) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p) AS text
  FROM steps s LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE letter <> 'D' GROUP BY s.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (short) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(first) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(way, 9) AS BIGINT), 0) AS cost, coalesce(substr(way, 10), '') AS audit, sha256(coalesce(f.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fixed f ON f.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_trie": rf"""
WITH turns AS (SELECT conv_id, list({{'k': md5(coalesce(role, '')) || md5(coalesce(text, '')), 'b': octet_length(encode(coalesce(text, '')))::BIGINT}} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, CAST({_crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS INT) AS h FROM turns),
whole AS (SELECT a.conv_id, list_concat(coalesce(b.own, [])[1 : a.h], a.own[a.h + 1 : len(a.own)]) AS t FROM h a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (SELECT conv_id, d, len(t) = d AS ends, sha256(array_to_string(list_transform(t[1 : d], lambda x: x.k), ',')) AS p, sha256(array_to_string(list_transform(t[1 : d - 1], lambda x: x.k), ',')) AS up, CASE WHEN d > 0 THEN t[d].b ELSE 0 END AS b FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM whole)),
nodes AS (SELECT d, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(b) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY d, p),
tops AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.up = n.p) AS kids FROM nodes n),
above AS (SELECT a.d, a.p, sum(CASE WHEN t.kids = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves, sum(t.saved)::BIGINT AS saved FROM tops t JOIN prefixes a ON a.conv_id = t.conv_id AND a.d <= t.d GROUP BY ALL)
SELECT t.conv_id, t.d AS depth, o.conv_id AS parent_conv_id, t.n AS n_convs, t.kids AS n_children, a.leaves AS n_leaves, a.saved AS saved_tokens, t.ends_sha256
FROM tops t JOIN above a USING (d, p) LEFT JOIN nodes o ON o.d = t.d - 1 AND o.p = t.up""",
}
