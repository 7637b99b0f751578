"""The library's registered queries and their SQL, by name.

A query applies operators to whole tables; `sql` is an equivalent that DuckDB
runs on the same tables.  Floats are rounded to six digits in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqengine.functions import scalars as S
from seqengine.functions import tables
from seqengine.operators import augment as A
from seqengine.operators import encode as E
from seqengine.operators import metrics as M
from seqengine.operators import network as N
from seqengine.operators import planned as D
from seqengine.operators import prep as P
from seqengine.operators import score
from seqengine.operators import signal as G
from seqengine.operators import vocab as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def six(c: Column | str) -> Column:
    return F.round(c, 6)


# Documents as labels: the words of a text, its language as the fold, its source as the writer.
_WORDS = "SELECT lang, unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS label FROM documents"
_LABELS = f"SELECT DISTINCT lang, label FROM ({_WORDS}) WHERE label <> ''"
_PAIRS = f"SELECT lang, label[i:i+1] AS bigram FROM (SELECT lang, label, unnest(range(1, len(label))) AS i FROM ({_LABELS}) WHERE len(label) > 1)"


def labels(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select("lang", F.explode(F.split("text", r"[^\p{L}]+")).alias("label"))
    return words.where("label <> ''")


@query(f"SELECT lang, count(*) AS labels FROM ({_LABELS}) GROUP BY lang")
def label_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return labels(spark, folder).distinct().groupBy("lang").agg(F.count("*").alias("labels"))


@query(f"SELECT lang, bigram, count(*) AS count FROM ({_PAIRS}) GROUP BY lang, bigram")
def bigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return V.bigram_counts(labels(spark, folder), ["lang"])


@query(f"""
WITH l AS ({_LABELS}), c AS (SELECT DISTINCT lang, unnest(string_split(label, '')) AS token FROM l UNION SELECT DISTINCT lang, '' FROM l),
b AS (SELECT lang, bigram AS token, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, bigram) AS r FROM ({_PAIRS}) GROUP BY lang, bigram),
u AS (SELECT lang, 0 AS s, row_number() OVER (PARTITION BY lang ORDER BY token) AS r, token FROM c UNION ALL SELECT lang, 1, r, token FROM b WHERE r <= 50)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s, r) - 1 AS token_id, token FROM u""")
def bigram_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return V.bigram_vocab(labels(spark, folder), ["lang"], top=50).withColumn("token_id", F.col("token_id").cast("long"))


@query(f"""
WITH l AS ({_LABELS}), c AS (SELECT lang, count(DISTINCT ch) + 1 AS letters FROM (SELECT lang, unnest(string_split(label, '')) AS ch FROM l) GROUP BY lang),
b AS (SELECT lang, count(DISTINCT bigram) AS available FROM ({_PAIRS}) GROUP BY lang)
SELECT lang, size, greatest(0, least(size - letters, available)) AS bigrams, letters + greatest(0, least(size - letters, available)) AS tokens
FROM c JOIN b USING (lang), (VALUES (100), (200), (300), (400), (500)) s(size)""")
def vocab_size_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return V.vocab_sizes(labels(spark, folder), ["lang"], [100, 200, 300, 400, 500]).select("lang", "size", F.col("bigrams").cast("long"), F.col("tokens").cast("long"))


def part_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_name").alias("label"))


#: The empty string at 0, then printable ASCII: id = code point - 31.
ASCII = ["", *map(chr, range(32, 127))]


@query("SELECT row_number() OVER (ORDER BY token) - 1 AS token_id, token FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS token FROM part UNION SELECT '')")
def char_vocab(spark: SparkSession, folder: str) -> DataFrame:
    tokens = [r[0] for r in V.alphabet(part_labels(spark, folder)).collect()]
    return V.char_vocab(part_labels(spark, folder), ["", *sorted(tokens)]).select(F.col("token_id").cast("long"), "token")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: ascii(c) - 31), ',') AS ids FROM part")
def char_encode(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.array_join(E.encode_chars(F.col("p_name"), ASCII).cast("array<string>"), ",").alias("ids"))


@query("SELECT p_partkey, p_name AS text FROM part")
def char_decode(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", E.decode_ids(E.encode_chars(F.col("p_name"), ASCII), ASCII).alias("text"))


_PART_PAIRS = "SELECT label[i:i+1] AS bigram, count(*) AS n FROM (SELECT label, unnest(range(1, len(label))) AS i FROM (SELECT DISTINCT p_name AS label FROM part)) GROUP BY 1"


def _part_bigrams(spark: SparkSession, folder: str) -> list[str]:
    rows = V.bigram_counts(part_labels(spark, folder)).orderBy(F.desc("count"), "bigram").limit(20).collect()
    return [*ASCII, *(r["bigram"] for r in rows)]


@query(f"""
WITH RECURSIVE v AS (SELECT bigram FROM ({_PART_PAIRS}) ORDER BY n DESC, bigram LIMIT 20),
s AS (SELECT p_name, 1 AS i, CAST([] AS VARCHAR[]) AS out FROM (SELECT DISTINCT p_name FROM part)
  UNION ALL SELECT p_name, i + CASE WHEN i < len(p_name) AND p_name[i:i+1] IN (SELECT bigram FROM v) THEN 2 ELSE 1 END,
  list_append(out, CASE WHEN i < len(p_name) AND p_name[i:i+1] IN (SELECT bigram FROM v) THEN p_name[i:i+1] ELSE p_name[i] END) FROM s WHERE i <= len(p_name))
SELECT p_partkey, array_to_string(out, '|') AS tokens FROM part JOIN s USING (p_name) WHERE i > len(p_name)""")
def bigram_encode(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _part_bigrams(spark, folder)
    ids = E.encode_greedy(F.col("p_name"), tokens)
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.transform(ids, lambda i: F.element_at(F.array(*map(F.lit, tokens)), i + 1)), "|").alias("tokens"))


@query("SELECT count(*) AS labels, CAST(0 AS BIGINT) AS mismatches FROM part")
def bigram_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _part_bigrams(spark, folder)
    back = E.decode_ids(E.encode_greedy(F.col("p_name"), tokens), tokens)
    return table(spark, folder, "part").agg(F.count("*").alias("labels"), F.count_if(back != F.col("p_name")).alias("mismatches"))


@query()
def bpe_vocab(spark: SparkSession, folder: str) -> DataFrame:
    tokens, _ = V.fit_bpe(part_labels(spark, folder), 100)
    return spark.createDataFrame(list(enumerate(tokens)), "token_id int, token string")


@query("SELECT p_partkey, replace(p_name, ' ', '') AS text FROM part")
def bpe_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded and decoded: spaces between words are not restored."""
    tokens, merges = V.fit_bpe(part_labels(spark, folder), 100)
    ids = E.encode_bpe(F.col("p_name"), tokens, merges)
    return table(spark, folder, "part").select("p_partkey", E.decode_ids(ids, tokens, (0,)).alias("text"))


@query("SELECT p_partkey, replace(p_name, ' ', '') AS text FROM part")
def unigram_encode(spark: SparkSession, folder: str) -> DataFrame:
    pieces = V.fit_unigram(part_labels(spark, folder), 80)
    ids = E.encode_unigram(F.col("p_name"), pieces)
    return table(spark, folder, "part").select("p_partkey", E.decode_ids(ids, [t for t, _ in pieces], (0,)).alias("text"))


@query(f"""
WITH RECURSIVE v AS (SELECT bigram FROM ({_PART_PAIRS}) ORDER BY n DESC, bigram LIMIT 20),
s AS (SELECT p_name, 1 AS i, CAST([] AS VARCHAR[]) AS out FROM (SELECT DISTINCT p_name FROM part)
  UNION ALL SELECT p_name, i + CASE WHEN i < len(p_name) AND p_name[i:i+1] IN (SELECT bigram FROM v) THEN 2 ELSE 1 END,
  list_append(out, CASE WHEN i < len(p_name) AND p_name[i:i+1] IN (SELECT bigram FROM v) THEN p_name[i:i+1] ELSE p_name[i] END) FROM s WHERE i <= len(p_name))
SELECT p_partkey, array_to_string(out, '|') AS tokens FROM part JOIN s USING (p_name) WHERE i > len(p_name)""")
def longest_match(spark: SparkSession, folder: str) -> DataFrame:
    """The longest known token is a bigram here, so pieces are those of the greedy pairs."""
    tokens = _part_bigrams(spark, folder)
    ids = E.longest_match(F.col("p_name"), tokens)
    rows = table(spark, folder, "part").select("p_partkey", ids.alias("ids"))
    return rows.select("p_partkey", F.array_join(F.transform("ids", lambda i: F.element_at(F.array(*map(F.lit, tokens)), i + 1)), "|").alias("tokens"))


@query("SELECT source, count(*) AS members, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
def writer_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = G.group_members(table(spark, folder, "documents"), "source", "doc_id")
    return groups.select("source", F.size("members").cast("long").alias("members"), F.array_join(F.col("members").cast("array<string>"), ",").alias("ids"))


@query("""
WITH g AS (SELECT source, list(doc_id ORDER BY doc_id) AS m FROM documents GROUP BY source)
SELECT source, doc_id, concat_ws(',', m[(doc_id * 31) % len(m) + 1], doc_id, m[(doc_id * 31 + 1) % len(m) + 1], m[(doc_id * 31 + 2) % len(m) + 1]) AS parts
FROM documents JOIN g USING (source)""")
def writer_concat(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.concat_same_group(table(spark, folder, "documents").select("source", "doc_id"), "source", "doc_id", 3, F.col("doc_id") * 31, chunk=F.expr("doc_id div 4096"))
    return rows.select("source", "doc_id", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 AND n_chars <= 1024")
def length_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(P.usable_length(F.col("n_chars"))).select("doc_id", "n_chars")


@query("""
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS id,
  'data/' || lang || '/train/' || lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS VARCHAR), 8, '0') || '.csv' AS filename FROM documents""")
def fold_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.dense_ids(table(spark, folder, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], chunk=F.expr("doc_id div 4096"))
    return rows.withColumn("filename", P.file_path(F.col("lang"), F.lit("train"), F.col("id")))


@query("SELECT vec_id, label, len(embedding) AS steps FROM embeddings")
def positional_zip(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return P.zip_positions(rows.select("vec_id", "label"), rows.select("vec_id", F.size("embedding").cast("long").alias("steps")), "vec_id")


@query("SELECT d.doc_id, d.lang, l.quality, d.n_chars FROM documents d JOIN labels l USING (doc_id)")
def annotation_join(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select("doc_id", "lang", "quality", "n_chars")


_SPLIT = "doc_id % 3 = 0"


@query(f"SELECT DISTINCT source FROM documents WHERE {_SPLIT} INTERSECT SELECT source FROM documents WHERE NOT {_SPLIT}")
def writer_overlap(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents")
    return P.group_overlap(rows.where(_SPLIT), rows.where(f"not ({_SPLIT})"), "source")


@query("SELECT lang FROM documents WHERE lang = 'de' INTERSECT SELECT lang FROM documents WHERE lang <> 'de'")
def writer_disjoint(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents")
    return P.group_overlap(rows.where("lang = 'de'"), rows.where("lang <> 'de'"), "lang")


@query("SELECT p_partkey, levenshtein(p_name, replace(p_name, 'e', '')) AS edits FROM part")
def levenshtein_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.levenshtein("p_name", F.expr("replace(p_name, 'e', '')")).cast("long").alias("edits"))


def part_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Names as references; as hypotheses, names without e and, of odd parts, without the first word."""
    hyp = F.expr("if(p_partkey % 2 = 1, regexp_replace(p_name, '^[a-z]+ ', ''), replace(p_name, 'e', ''))")
    return table(spark, folder, "part").select("p_partkey", "p_brand", F.col("p_name").alias("ref"), hyp.alias("hyp"))


_PART_HYP = "SELECT p_partkey, p_brand, p_name AS ref, CASE WHEN p_partkey % 2 = 1 THEN regexp_replace(p_name, '^[a-z]+ ', '') ELSE replace(p_name, 'e', '') END AS hyp FROM part"


@query(f"""SELECT p_brand, round(avg(levenshtein(hyp, ref)), 6) AS levenshtein_distance, round(avg(length(ref)), 6) AS average_sentence_length,
  round(sum(levenshtein(hyp, ref))::DOUBLE / sum(length(ref)), 6) AS character_error_rate, -1.0::DOUBLE AS word_error_rate FROM ({_PART_HYP}) GROUP BY p_brand""")
def cer_by_group(spark: SparkSession, folder: str) -> DataFrame:
    out = M.evaluate(part_pairs(spark, folder), ["p_brand"], wer=False)
    return out.select("p_brand", *[six(c).alias(c) for c in out.columns if c != "p_brand"])


@query(f"""
WITH p AS (SELECT p_brand, string_split(ref, ' ') AS r, string_split(hyp, ' ') AS h FROM ({_PART_HYP})), v AS (SELECT *, list_sort(list_distinct(list_concat(r, h))) AS v FROM p),
e AS (SELECT p_brand, len(r) AS n, levenshtein(array_to_string(list_transform(r, lambda w: chr(64 + list_position(v, w)::INT)), ''),
  array_to_string(list_transform(h, lambda w: chr(64 + list_position(v, w)::INT)), '')) AS d FROM v)
SELECT p_brand, round(sum(d)::DOUBLE / sum(n), 6) AS word_error_rate FROM e GROUP BY p_brand""")
def wer_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return M.evaluate(part_pairs(spark, folder), ["p_brand"], distance=False).select("p_brand", six("word_error_rate").alias("word_error_rate"))


@query(f"SELECT p_brand, round(avg((ref = hyp)::INT), 6) AS exact FROM ({_PART_HYP}) GROUP BY p_brand")
def exact_match_rate(spark: SparkSession, folder: str) -> DataFrame:
    return part_pairs(spark, folder).groupBy("p_brand").agg(six(F.avg((F.col("ref") == F.col("hyp")).cast("int"))).alias("exact"))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_name").alias("ref"), F.expr("replace(p_name, 'e', '#')").alias("hyp"))


@query("SELECT '#' AS hyp, 'e' AS ref, CAST(sum(list_sum(list_transform(regexp_extract_all(p_name, 'e+'), lambda r: len(r) * len(r)))) AS BIGINT) AS count FROM part")
def substitution_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return M.substitutions(M.aligned(_marked(spark, folder)))


@query("""SELECT '#' AS hyp, 'e' AS ref, round(sum(list_sum(list_transform(regexp_extract_all(p_name, 'e+'), lambda r: len(r) * len(r))))
  / (sum(length(p_name) - length(replace(p_name, 'e', ''))) + 1e-9::DOUBLE), 6) AS rate FROM part""")
def substitution_rate(spark: SparkSession, folder: str) -> DataFrame:
    return M.substitution_rates(_marked(spark, folder)).select("hyp", "ref", six("rate").alias("rate"))


@query("""SELECT 'equal' AS event, CAST(sum(length(replace(p_name, 'e', ''))) AS BIGINT) AS total FROM part
UNION ALL SELECT 'substitute', CAST(sum(length(p_name) - length(replace(p_name, 'e', ''))) AS BIGINT) FROM part""")
def edit_event_totals(spark: SparkSession, folder: str) -> DataFrame:
    return M.event_totals(M.aligned(_marked(spark, folder)))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS label_id FROM embeddings")
def frame_argmax(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", S.argmax(F.col("embedding")).alias("label_id"))


_RUNS = "SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events"


@query(f"SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS path FROM ({_RUNS}) WHERE event_type IS DISTINCT FROM before AND event_type <> 'error' GROUP BY user_id")
def ctc_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """The user's event types as frames: collapsed, then without the blank, error."""
    frame = F.struct("ts", "event_id", "event_type")
    paths = table(spark, folder, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(frame)), lambda s: s["event_type"]).alias("frames"))
    kept = F.filter(S.collapse(F.col("frames")), lambda x: x != "error")
    return paths.select("user_id", F.array_join(kept, ",").alias("path"))


_HIST = "SELECT label AS token, count(*) AS count, count(*) / sum(count(*)) OVER () AS ratio FROM (SELECT label FROM (%s) WHERE label <> '') GROUP BY label" % _WORDS


@query("SELECT event_type AS token, count(*) AS count, round(count(*) / (SELECT count(*) FROM events WHERE event_type <> 'error'), 6) AS ratio FROM events WHERE event_type <> 'error' GROUP BY event_type")
def token_histogram(spark: SparkSession, folder: str) -> DataFrame:
    out = M.token_histogram(table(spark, folder, "events").select(F.col("event_type").alias("token")), "error")
    return out.withColumn("ratio", six("ratio"))


@query(f"SELECT token, count, round(ratio, 6) AS ratio FROM ({_HIST})")
def token_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return M.token_histogram(labels(spark, folder).select(F.col("label").alias("token"))).withColumn("ratio", six("ratio"))


@query(f"SELECT CAST(length(token) AS BIGINT) AS length, round(sum(ratio), 6) AS ratio FROM ({_HIST}) GROUP BY 1")
def token_length_ratio(spark: SparkSession, folder: str) -> DataFrame:
    shares = M.length_shares(M.token_histogram(labels(spark, folder).select(F.col("label").alias("token"))))
    return shares.select(F.col("length").cast("long"), six("ratio").alias("ratio"))


@query(f"SELECT round(avg(ratio), 9) AS mean, round(stddev_pop(ratio), 9) AS std FROM ({_HIST})")
def ratio_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    out = M.share_summary(M.token_histogram(labels(spark, folder).select(F.col("label").alias("token"))))
    return out.select(F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6::DOUBLE), 6) AS value FROM events WINDOW w AS (PARTITION BY user_id)")
def zscore(spark: SparkSession, folder: str) -> DataFrame:
    return G.z_score(table(spark, folder, "events").select("event_id", "user_id", "value"), ["user_id"], ["value"]).select("event_id", six("value").alias("value"))


@query("SELECT vec_id, 80 AS steps, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def pad_fixed(spark: SparkSession, folder: str) -> DataFrame:
    padded = S.pad(F.col("embedding").cast("array<double>"), 80)
    return table(spark, folder, "embeddings").select("vec_id", F.size(padded).alias("steps"), F.round(F.aggregate(padded, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT vec_id, greatest(64, label * 16) AS steps FROM embeddings")
def pad_ctc_min(spark: SparkSession, folder: str) -> DataFrame:
    padded = S.pad(F.col("embedding").cast("array<double>"), S.ctc_least(F.col("label"), 8))
    return table(spark, folder, "embeddings").select("vec_id", F.size(padded).alias("steps"))


@query("""SELECT doc_id, doc_id // 64 AS batch, max(length(text)) OVER (PARTITION BY doc_id // 64) AS longest FROM documents""")
def batch_max_len(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.batch_lengths(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"], F.length("text").cast("long"), 64, "doc_id")
    return rows.select("doc_id", "batch", "longest")


@query("SELECT CAST(ceil(count(*) / 64) AS BIGINT) AS batches FROM documents")
def batch_count(spark: SparkSession, folder: str) -> DataFrame:
    return P.batch_count(table(spark, folder, "documents"), 64)


@query("""SELECT batch, count(*) AS items, max(n) AS time, CAST(sum(n) AS BIGINT) AS steps, round(sum(n * list_sum(list_transform(e, lambda x: x::DOUBLE))), 3) AS total,
  CAST(max(m) * count(*) AS BIGINT) AS label_cells, CAST(sum(label * m) AS BIGINT) AS label_sum, CAST(sum(m) AS BIGINT) AS labels
FROM (SELECT vec_id // 64 AS batch, 1 + vec_id % 7 AS n, 1 + vec_id % 3 AS m, label, embedding AS e FROM embeddings) GROUP BY batch""")
def collate(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings of 1 to 7 steps of 64 channels with 1 to 3 labels in padded batches: sizes, and sums of all cells."""
    ids = F.array_repeat("label", (1 + F.col("vec_id") % 3).cast("int"))
    rows = table(spark, folder, "embeddings").select("vec_id", F.array_repeat(F.col("embedding").cast("array<double>"), (1 + F.col("vec_id") % 7).cast("int")).alias("values"), ids.alias("ids"))
    out = G.collate(rows, 64, "vec_id")
    total = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    whole = lambda c: total(F.flatten(c) if isinstance(c, str) else c, F.lit(0).cast("long"))
    return out.select(
        "batch", F.size("seqs").cast("long").alias("items"), F.size(F.col("seqs")[0][0]).cast("long").alias("time"), whole(F.col("lens_seq").cast("array<long>")).alias("steps"),
        F.round(total(F.flatten(F.flatten("seqs")).cast("array<double>"), F.lit(0.0)), 3).alias("total"),
        F.size(F.flatten("labels")).cast("long").alias("label_cells"), whole(F.flatten("labels").cast("array<long>")).alias("label_sum"), whole(F.col("lens_label").cast("array<long>")).alias("labels"),
    )


@query("SELECT user_id, count(*) // 8 AS frames FROM events GROUP BY user_id")
def downsample_len(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(S.downsampled(F.count("*")).alias("frames"))


@query("SELECT user_id, (count(*) - 2) // 2 + 1 AS patches FROM events GROUP BY user_id")
def patch_len(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(score.patches(F.count("*")).alias("patches"))


@query("""SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS total, round(value - first_value(value) OVER w, 6) AS shift
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def cumsum_baseline(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    both = G.from_baseline(G.cumulative(rows, ["user_id"], ["ts", "event_id"], "value"), ["user_id"], ["ts", "event_id"], "value")
    return both.select("event_id", F.round("total", 4).alias("total"), six("shift").alias("shift"))


_MASKED = "SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS seen FROM events"


@query(f"SELECT event_id, coalesce(last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), value) AS filled FROM ({_MASKED})")
def ffill_block(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return G.forward_fill(rows, ["user_id"], ["ts", "event_id"], "value", F.col("event_id") % 7 == 0).select("event_id", "filled")


@query(f"SELECT event_id, coalesce(first_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), value) AS filled FROM ({_MASKED})")
def bfill_block(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return G.backward_fill(rows, ["user_id"], ["ts", "event_id"], "value", F.col("event_id") % 7 == 0).select("event_id", "filled")


def _vectors(spark: SparkSession, folder: str, values: Callable[[Column], Column]) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode(values(F.col("embedding").cast("array<double>"))).alias("k", "v"))
    return rows.select("vec_id", F.col("k").cast("long"), six("v").alias("v"))


_WIDE = "SELECT vec_id, unnest(range(64)) AS k, unnest(e) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@query(f"SELECT vec_id, k, round(x / (max(abs(x)) OVER (PARTITION BY vec_id) + 1e-6::DOUBLE), 6) AS v FROM ({_WIDE})")
def rowmax_norm(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, S.row_max_norm)


@query(f"SELECT vec_id, k, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS v FROM ({_WIDE})")
def softmax(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, S.softmax)


@query(f"SELECT vec_id, k, round(0.99::DOUBLE * (exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id)) + 0.01::DOUBLE / 64, 6) AS v FROM ({_WIDE})")
def smooth_probs(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, lambda e: S.smooth(S.softmax(e), 0.01))


@query(f"SELECT vec_id, k, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6::DOUBLE), 6) AS v FROM ({_WIDE}) WINDOW w AS (PARTITION BY vec_id)")
def zscore_array(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, S.z_array)


@query("""
WITH s AS (SELECT user_id, value AS v, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT DISTINCT user_id, n, k FROM s, range(50) r(k)), p AS (SELECT *, k * ((n - 1) / 49::DOUBLE) AS x, least(floor(k * ((n - 1) / 49::DOUBLE)), greatest(n - 2, 0)) AS lo FROM g)
SELECT p.user_id, p.k AS step, round(a.v + (x - lo) * (coalesce(b.v, a.v) - a.v), 5) AS value FROM p JOIN s a ON a.user_id = p.user_id AND a.t = lo LEFT JOIN s b ON b.user_id = p.user_id AND b.t = lo + 1""")
def resample_linear(spark: SparkSession, folder: str) -> DataFrame:
    steps = P.dense_ids(table(spark, folder, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "t")
    return G.resample(steps, ["user_id"], "t", "value", 50).select("user_id", F.col("step").cast("long"), F.round("value", 5).alias("value"))


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events in order as a recording of one channel."""
    return G.to_arrays(table(spark, folder, "events").withColumn("t", F.struct("ts", "event_id")), ["user_id"], ["value"])


def _augmented(spark: SparkSession, folder: str, kernel: A.Kernel) -> DataFrame:
    return A.augment(recordings(spark, folder), "user_id", kernel, 7).select("user_id", F.size("values").cast("long").alias("steps"), F.transform("values", lambda v: v[0]).alias("channel"))


@query()
def noise(spark: SparkSession, folder: str) -> DataFrame:
    return _augmented(spark, folder, A.noise(0, 0.05, multiplicative=True))


@query()
def drift(spark: SparkSession, folder: str) -> DataFrame:
    return _augmented(spark, folder, A.drift(0.1, 40, multiplicative=True))


@query()
def dropout(spark: SparkSession, folder: str) -> DataFrame:
    return _augmented(spark, folder, A.dropout(0.05, (1, 3), "ffill", per_channel=True))


@query()
def time_warp(spark: SparkSession, folder: str) -> DataFrame:
    return _augmented(spark, folder, A.time_warp(5, 4.0))


@query("SELECT user_id, count(*) AS steps FROM events GROUP BY user_id")
def augment_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Noise, drift and warp keep the length of every recording."""
    kernel = A.gated([A.noise(0, 0.05, multiplicative=True), A.drift(0.1, 40, multiplicative=True), A.time_warp(5, 4.0)], 0.5)
    return _augmented(spark, folder, kernel).select("user_id", "steps")


# Months of orders as epochs.
_MONTHS = "SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS epoch, o_totalprice AS loss, o_custkey FROM orders"


def losses(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    return rows.select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("epoch"), F.col("o_totalprice").alias("loss"), "o_custkey")


@query("SELECT o_orderkey, o_orderkey % 10 = 0 OR o_orderkey = 999 AS due FROM orders")
def step_predicate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", S.step_due(F.col("o_orderkey"), 10, 999).alias("due"))


@query(f"SELECT epoch, round(avg(loss), 4) AS loss_avg FROM ({_MONTHS}) GROUP BY epoch")
def epoch_loss_avg(spark: SparkSession, folder: str) -> DataFrame:
    return losses(spark, folder).groupBy("epoch").agg(F.round(F.avg("loss"), 4).alias("loss_avg"))


_MINIMA = f"SELECT epoch, min(loss) AS loss FROM ({_MONTHS}) GROUP BY epoch"


@query(f"""SELECT epoch, loss, coalesce(loss < min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM ({_MINIMA})""")
def running_best(spark: SparkSession, folder: str) -> DataFrame:
    epochs = losses(spark, folder).groupBy("epoch").agg(F.min("loss").alias("loss")).withColumn("run", F.lit(0))
    return M.running_best(epochs, ["run"], "epoch", "loss").drop("run")


_METRICS = f"SELECT o_custkey % 5 AS fold, epoch, 'character_error_rate' AS metric, min(loss) AS value FROM ({_MONTHS}) GROUP BY ALL UNION ALL SELECT o_custkey % 5, epoch, 'word_error_rate', max(loss) FROM ({_MONTHS}) GROUP BY ALL"


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    wide = losses(spark, folder).groupBy((F.col("o_custkey") % 5).alias("fold"), "epoch").agg(F.min("loss").alias("character_error_rate"), F.max("loss").alias("word_error_rate"))
    return wide.unpivot(["fold", "epoch"], ["character_error_rate", "word_error_rate"], "metric", "value")


@query(f"SELECT fold, metric, arg_min(epoch, (value, epoch)) AS epoch, min(value) AS value FROM ({_METRICS}) GROUP BY fold, metric")
def best_epoch(spark: SparkSession, folder: str) -> DataFrame:
    return M.best_epochs(_metrics(spark, folder), ["fold"])


@query(f"""
WITH m AS ({_METRICS}), b AS (SELECT fold, arg_min(epoch, (value, epoch)) AS epoch FROM m WHERE metric = 'character_error_rate' GROUP BY fold)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 4) AS std FROM m JOIN b USING (fold, epoch) GROUP BY metric""")
def cv_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    return M.cross_validation(_metrics(spark, folder)).select("metric", six("mean").alias("mean"), F.round("std", 4).alias("std"))


@query("""SELECT step, round(0.001::DOUBLE * CASE WHEN step < 300 THEN 0.01::DOUBLE + 0.99::DOUBLE * step / 300
  ELSE 0.5::DOUBLE * (1 + cos(pi() * least(step - 300, 2700) / 2700)) END, 9) AS lr FROM range(3000) t(step)""")
def lr_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(3000).select(F.col("id").alias("step"), F.round(S.learning_rate(F.col("id"), 100, 30, 3, 0.001), 9).alias("lr"))


@query("""SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN -c_acctbal END AS v FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey""")
def result_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer")
    old = rows.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_acctbal").alias("v"))
    new = rows.where("c_custkey % 2 = 0").select("c_custkey", F.expr("if(c_custkey % 4 <> 0, -c_acctbal, null)").alias("v"))
    return M.upsert(old, new, ["c_custkey"])


@query("""SELECT event_id, CAST(floor(value * 100)::BIGINT // 3600 AS VARCHAR) || ':' || lpad(CAST(floor(value * 100)::BIGINT % 3600 // 60 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST(floor(value * 100)::BIGINT % 60 AS VARCHAR), 2, '0') AS clock FROM events""")
def sec2time_fmt(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", S.clock(F.col("value") * 100).alias("clock"))


@query("SELECT event_id, CAST(props->>'k' AS INT) AS k FROM events")
def props_json(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def _frames() -> Column:
    """An embedding's softmax as eight frames of eight classes."""
    return S.let(S.softmax(F.col("embedding").cast("array<double>")), lambda p: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(p, k * 8 + 1, 8)))


@query("""
WITH f AS (SELECT vec_id, 1 + label % 7 AS y, k, list_transform(embedding, lambda x: exp(x::DOUBLE))[k * 8 + 1 : k * 8 + 8] AS r FROM embeddings, range(8) t(k)),
p AS (SELECT vec_id, k, 0.999999::DOUBLE * r[1] / list_sum(r) + 1e-6::DOUBLE / 8 AS b, 0.999999::DOUBLE * r[y + 1] / list_sum(r) + 1e-6::DOUBLE / 8 AS q FROM f),
s AS (SELECT vec_id, a.k AS first, z.k AS last, sum(ln(CASE WHEN p.k BETWEEN a.k AND z.k THEN q ELSE b END)) AS l FROM p, range(8) a(k), range(8) z(k) WHERE a.k <= z.k GROUP BY ALL)
SELECT vec_id, round(-ln(sum(exp(l))), 6) AS loss FROM s GROUP BY vec_id""")
def ctc_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Eight frames of eight classes from each embedding, against its label; the SQL sums over the label's first and last frame."""
    rows = table(spark, folder, "embeddings").select("vec_id", _frames().alias("frames"), F.array(1 + F.col("label") % 7).alias("ids"))
    return score.ctc_loss(rows, "vec_id").select("vec_id", six("loss").alias("loss"))


@query()
def forced_alignment(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", _frames().alias("frames"), F.array(1 + F.col("label") % 7, F.lit(7)).alias("ids"))
    return score.forced_alignment(rows, "vec_id", ratio=8)


_LETTERS = f"SELECT lang, label[i:i+1] AS pair, len(label)::DOUBLE AS score FROM (SELECT lang, label, unnest(range(1, len(label))) AS i FROM ({_WORDS}) WHERE len(label) > 1)"


@query(f"""SELECT pair, count(*) AS count, count(DISTINCT lang) AS coverage, median(score) AS median, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr FROM ({_LETTERS}) GROUP BY pair""")
def pair_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Bigrams of all words, with the word's length as score and the language as writer."""
    rows = labels(spark, folder).where(F.length("label") > 1)
    rows = rows.groupBy("lang", "label").agg(F.count("*").alias("times"))  # a word is cut into bigrams once, however often it occurs
    places = F.transform(F.sequence(F.lit(1), F.length("label") - 1), lambda i: F.substring(F.col("label"), i, F.lit(2)))
    pairs = rows.select("lang", F.explode(places).alias("pair"), F.length("label").cast("double").alias("score"), "times")
    return D.pair_statistics(pairs, group="lang", times="times").withColumn("iqr", six("iqr"))


@query(f"""WITH s AS (SELECT pair, count(*) AS count, count(DISTINCT lang) AS coverage, median(score) AS median FROM ({_LETTERS}) GROUP BY pair)
SELECT pair, row_number() OVER (ORDER BY median DESC, count DESC, pair) AS rank FROM s WHERE count >= 5 AND coverage >= 2 ORDER BY rank LIMIT 25""")
def motion_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return D.motion_bigrams(pair_stats(spark, folder), 25, 5, 2).select("pair", F.col("rank").cast("long"))


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 4) AS std FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def boundary_features(spark: SparkSession, folder: str) -> DataFrame:
    steps = P.dense_ids(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "t")
    out = D.boundary_features(steps, ["user_id"], ["value"], [5])
    return out.select("event_id", six("value_mean_5").alias("mean"), F.round("value_std_5", 4).alias("std"))


@query("SELECT event_id, round(least(1, greatest(0, (2 * value / 100 + (event_type = 'error')::INT) / 3)), 6) AS score FROM events")
def continuity_score(spark: SparkSession, folder: str) -> DataFrame:
    parts = [F.col("value") / 100, (F.col("event_type") == "error").cast("double")]
    return table(spark, folder, "events").select("event_id", six(D.continuity(parts, [2, 1])).alias("score"))


_ALPHABET = "".join(P.CATEGORIES)


@query(f"""SELECT vec_id, trim('{_ALPHABET}'[label * 5 + 1] || '{_ALPHABET}'[vec_id % 59 + 1] || ' ') AS text FROM embeddings""")
def index_labels(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.array(F.col("label") * 5, (F.col("vec_id") % 59).cast("int"), F.lit(59).cast("int"))
    return table(spark, folder, "embeddings").select("vec_id", P.label_of(F.transform(ids, lambda i: F.least(i, F.lit(59)))).alias("text"))


@query()
def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred ids of a seeded permutation; a test holds the order against the hashes."""
    return P.shuffled(table(spark, folder, "documents").select("doc_id"), "doc_id", 42, 3).limit(100)


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def fold_select(spark: SparkSession, folder: str) -> DataFrame:
    return P.select_fold(table(spark, folder, "documents"), "fr", "lang").select("doc_id", "lang")


@query("SELECT token, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, token) AS place FROM (SELECT event_type AS token FROM events) GROUP BY token")
def sorted_by_count(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").groupBy(F.col("event_type").alias("token")).agg(F.count("*").alias("count"))
    ordered = P.by_count(rows).agg(F.collect_list(F.struct("token", "count")).alias("r"))
    return ordered.select(F.posexplode("r").alias("p", "r")).select("r.token", "r.count", (F.col("p") + 1).cast("long").alias("place"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT doc_id % 7))[2:], ',') AS rest FROM documents GROUP BY source")
def categories_without_blank(spark: SparkSession, folder: str) -> DataFrame:
    lists = table(spark, folder, "documents").groupBy("source").agg(F.sort_array(F.collect_set(F.col("doc_id") % 7)).alias("c"))
    return lists.select("source", F.array_join(P.without_blank(F.col("c")).cast("array<string>"), ",").alias("rest"))


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def default_setting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.select("doc_id", P.setting(F.col("quality"), -1).alias("quality"))


@query("SELECT vec_id, CAST(round(list_sum(list_transform(embedding, lambda x: CAST(x::DOUBLE / 3 AS FLOAT)::DOUBLE)), 4) AS DOUBLE) AS total, [label, label] AS ids FROM embeddings")
def typed_samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x / 3).alias("values"), F.array("label", "label").cast("array<long>").alias("ids"))
    kept = P.typed(rows)
    return kept.select("vec_id", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "ids")


@query(f"""
WITH m AS ({_METRICS}), b AS (SELECT fold, arg_min(epoch, (value, epoch)) AS epoch FROM m WHERE metric = 'character_error_rate' GROUP BY fold)
SELECT fold, epoch, metric, value FROM m JOIN b USING (fold, epoch)""")
def routed_epochs(spark: SparkSession, folder: str) -> DataFrame:
    return P.routed_epochs(_metrics(spark, folder), test=False)


@query("SELECT e.event_id, e.user_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def annotated_steps(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return P.annotated(names, table(spark, folder, "events").select("event_id", "user_id"), "user_id")


@query(f"""
WITH d AS (SELECT label, vec_id, '{"".join(P.CATEGORIES)}' AS a, list_transform(range(8), lambda k: list_position(embedding[k * 8 + 1 : k * 8 + 8], list_max(embedding[k * 8 + 1 : k * 8 + 8])) - 1) AS path FROM embeddings),
t AS (SELECT label, substr(a, 1 + CAST(vec_id % 7 AS INT), 1) AS ref, array_to_string(list_transform(list_filter(list_transform(range(1, 9), lambda i: CASE WHEN i = 1 OR path[i] <> path[i - 1] THEN path[i] ELSE 0 END), lambda x: x <> 0), lambda x: a[x]), '') AS hyp FROM d)
SELECT label, round(avg(levenshtein(hyp, ref)), 6) AS levenshtein_distance, round(avg(length(ref)), 6) AS average_sentence_length, round(sum(levenshtein(hyp, ref)) / sum(length(ref)), 6) AS character_error_rate FROM t GROUP BY label""")
def evaluation_step(spark: SparkSession, folder: str) -> DataFrame:
    """Decode, then compare: best paths of eight frames against a label of one character."""
    letters = ["", *P.CATEGORIES[:7]]
    batch = table(spark, folder, "embeddings").select("label", _frames().alias("frames"), F.lit(8).alias("len_seq"), F.array((1 + F.col("vec_id") % 7).cast("int")).alias("ids"))
    out = score.evaluation_step(batch, lambda ids: E.decode_ids(ids, letters), ["label"])
    return out.select("label", *[six(c).alias(c) for c in ("levenshtein_distance", "average_sentence_length", "character_error_rate")])


@query("SELECT vec_id, unnest(range(8)) AS place, unnest(list_transform(range(8), lambda k: (label + k) % 5)) AS token FROM embeddings")
def explode_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The table function in SQL."""
    tables.register(spark)
    table(spark, folder, "embeddings").createOrReplaceTempView("token_rows")
    return spark.sql("SELECT vec_id, cast(place AS bigint) AS place, cast(token AS bigint) AS token FROM token_rows, LATERAL explode_tokens(transform(sequence(0, 7), k -> cast((label + k) % 5 AS int)))")


@query("""SELECT 'equal' AS event, CAST(sum(length(p_name) - length(replace(p_name, 'e', ''))) AS BIGINT) * 0 + CAST(sum(length(replace(p_name, 'e', ''))) AS BIGINT) AS chars FROM part
UNION ALL SELECT 'substitute', CAST(sum(length(p_name) - length(replace(p_name, 'e', ''))) AS BIGINT) FROM part""")
def align_chars(spark: SparkSession, folder: str) -> DataFrame:
    """The table function in SQL, over names with # for e."""
    tables.register(spark)
    _marked(spark, folder).createOrReplaceTempView("pair_rows")
    different = "SELECT ref, hyp, count(*) AS n FROM pair_rows GROUP BY ref, hyp"  # equal pairs are aligned once, and a small file's rows are dealt over all tasks
    return spark.sql(f"SELECT a.event, cast(sum(length(a.ref) * p.n) AS bigint) AS chars FROM ({different}) p, LATERAL align_chars(p.ref, p.hyp) a GROUP BY a.event")


@query()
def tokenizer_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabularies of three kinds and sizes; tests hold them against the single fits."""
    return V.sweep(part_labels(spark, folder), [60, 80, 100])


@query("""SELECT * FROM (VALUES ('blconv_s', 'bilstm_s', 0), ('blconv_s', 'bilstm_s', 1)) t(encoder, decoder, num_concat),
(SELECT CAST(13 * 64 * 2 + 64 + 64 * 2 * 9 + 6 * 64 + 128 * 64 + 64 + 64 * 128 * 2 + 128 + 128 * 2 * 9 + 6 * 128 + 256 * 128 + 128 + 128 * 256 * 2 + 256 + 256 * 2 * 9 + 6 * 256 + 512 * 256 + 256
  + 8 * 64 * (256 + 64) + 16 * 64 + 8 * 64 * (128 + 64) + 16 * 64 + 128 * 500 + 500 AS BIGINT) AS params)""")
def network_params(spark: SparkSession, folder: str) -> DataFrame:
    rows = [("blconv_s", "bilstm_s", n, N.network_cost(13, "blconv_s", "bilstm_s", n).params) for n in (0, 1)]
    return spark.createDataFrame(rows, "encoder string, decoder string, num_concat int, params long")


@query()
def inference(spark: SparkSession, folder: str) -> DataFrame:
    """The inference hook with a fixed linear model and a softmax over ten classes."""

    def make_model():
        import numpy as np

        weights = np.random.default_rng(0).standard_normal((64, 10)).astype("float32")

        def predict(batch):
            logits = batch @ weights
            powers = np.exp(logits - logits.max(axis=1, keepdims=True))
            return powers / powers.sum(axis=1, keepdims=True)

        return predict

    return score.infer(table(spark, folder, "embeddings"), make_model, F.col("embedding"), 64).select("vec_id", S.argmax(F.col("frames")).alias("label_id"))
