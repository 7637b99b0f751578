"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqengine.llm.warc import audit, flip_marked, replicate, tree, warc_files

    files = warc_files(_table(spark, sf_dir, "pages"))
    found = audit(tree(files), tree(replicate(files, flip_marked)))
    return found.select(F.col("page_id_a").alias("page_id"), (F.col("end_a") - F.col("first_a")).alias("record_bytes"), F.col("digest_a").alias("sha256"), F.col("digest_b").alias("replica_sha256"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqengine.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from seqengine.llm.token_codes import read_documents, token_segments

    return read_documents(token_segments(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqengine.llm.substring_dedup import repeating_documents

    return repeating_documents(_table(spark, sf_dir, "documents"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqengine.llm.quotation import chat_parts, linked_messages

    parts = chat_parts(linked_messages(_table(spark, sf_dir, "conversations")))
    return parts.select("conv_id", "part", "messages", "quoting", F.md5("chat").alias("chat_md5"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from seqengine.llm.sentencepiece_codec import decode_digests, encode_column

    model = public_tokenizers.path("piece_bpe_32k.model")
    return decode_digests(encode_column(_table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqengine.llm.media import media_features, media_table

    return media_features(media_table(_table(spark, sf_dir, "documents")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqengine.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqengine.llm.language_id import fit, predict

    documents = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return predict(documents, fit(documents)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqengine.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_quotation_linking, op3_sentencepiece, op4_token_binary, op5_media_columns, op6_line_dedup, op7_language_id, op8_warc_fixity, op9_minhash_near_dedup, op10_benchmark_decontamination)}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

_RECORD = """'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:md5:' || md5(p) || '>' || e || 'WARC-Page-ID: ' || p || e
  || 'WARC-Date: 2024-01-01T00:00:00Z' || e || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || e
  || 'Content-Type: application/http; msgtype=response' || e || 'Content-Length: ' || strlen(body) || e || e"""

ORACLES: dict[str, str] = {
    "op2_quotation_linking": """
WITH m AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, role, text, list_transform(string_split(text, chr(10)), lambda x: {'level': length(replace(regexp_extract(x, '^((?:> ?)*)', 1), ' ', '')),
  'content': CASE WHEN length(regexp_extract(x, '^((?:> ?)*)', 1)) > 0 THEN regexp_replace(x, '^((?:> ?)*)', '') ELSE x END}) AS ls FROM m),
o AS (SELECT *, trim(array_to_string(list_transform(list_filter(ls, lambda x: x.level = 0), lambda x: x.content), chr(10))) AS own,
  len(list_filter(ls, lambda x: x.level > 0)) > 0 AS quoted,
  row_number() OVER w - 1 AS position, lag(turn) OVER w AS previous FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
v AS (SELECT *, unnest(list_distinct(list_transform(ls, lambda x: x.level))) AS lv FROM l),
s AS (SELECT conv_id, turn, role, text, lv, trim(regexp_replace(lower(unnest(regexp_extract_all(
  array_to_string(list_transform(list_filter(ls, lambda x: x.level = lv), lambda x: x.content), ' '), '[^.!?]+'))), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS s FROM v),
h AS (SELECT a.conv_id, a.turn, a.role, a.text, a.lv, b.turn AS source, count(DISTINCT a.s) AS hits FROM s a JOIN s b
  ON a.lv > 0 AND b.lv = 0 AND a.s = b.s AND a.s <> '' AND a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY ALL),
g AS (SELECT conv_id, turn, role, text, lv, arg_max(source, (hits, source)) AS source FROM h GROUP BY ALL),
b AS (SELECT conv_id, turn, role, text, arg_min(source, lv) AS source FROM g GROUP BY ALL),
f AS (SELECT o.conv_id, position, quoted, '<|' || coalesce(o.role, '') || '|>' || CASE WHEN source IS NOT NULL AND source IS DISTINCT FROM previous THEN '<|answers ' || source || '|>' ELSE '' END
  || chr(10) || own || '<|end|>' AS line FROM o LEFT JOIN b ON o.conv_id = b.conv_id AND o.turn = b.turn AND o.role = b.role AND o.text = b.text)
SELECT conv_id, position // 64 AS part, count(*) AS messages, count(*) FILTER (quoted) AS quoting, md5(string_agg(line, chr(10) ORDER BY position)) AS chat_md5
FROM f GROUP BY conv_id, position // 64""",
    "op8_warc_fixity": f"""
WITH r AS (SELECT page_id, CAST(page_id AS VARCHAR) AS p, url, chr(13) || chr(10) AS e,
  'TTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS tail, 'H' || tail AS body FROM pages)
SELECT page_id, strlen({_RECORD} || body || e || e) AS record_bytes, sha256({_RECORD} || body || e || e) AS sha256, sha256({_RECORD} || 'X' || tail || e || e) AS replica_sha256
FROM r WHERE md5(p)[1] = '0'""",
    "op6_line_dedup": """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS content FROM d),
s AS (SELECT doc_id, line, content, list_sort(list_distinct(list_filter(string_split(content, ' '), lambda w: w <> ''))) AS t FROM l),
c AS (SELECT t, len(t) AS n, min((doc_id, line)) AS f FROM s WHERE len(t) > 0 GROUP BY t),
i AS (SELECT row_number() OVER (ORDER BY f) AS id, * FROM c),
w AS (SELECT id, n, unnest(t) AS w FROM i),
df AS (SELECT w, count(*) AS df FROM w GROUP BY w),
o AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS p FROM w JOIN df USING (w)),
x AS (SELECT id, n, w FROM o WHERE p <= n - (4 * n + 4) // 5 + 1),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.w = b.w AND b.id < a.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
g AS (SELECT DISTINCT p.a AS id FROM p JOIN i a ON a.id = p.a JOIN i b ON b.id = p.b
  WHERE 5 * len(list_intersect(a.t, b.t)) >= 4 * (a.n + b.n - len(list_intersect(a.t, b.t)))),
k AS (SELECT s.doc_id, s.line, s.content, len(s.t) AS n, len(s.t) > 0 AND (i.f <> (s.doc_id, s.line) OR g.id IS NOT NULL) AS gone
  FROM s LEFT JOIN i ON i.t = s.t LEFT JOIN g ON g.id = i.id)
SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (gone) AS n_removed,
  md5(coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS text_md5
FROM k GROUP BY doc_id""",
    "op9_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
}
