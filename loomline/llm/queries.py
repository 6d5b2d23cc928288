"""The registered queries of the training-data operators."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.bpe import decode_documents, encode_documents
from loomline.llm.decontamination import find_contamination
from loomline.llm.language import fold_of, identify_language, train_language_model
from loomline.llm.mixing import mix_sources
from loomline.llm.neardup import near_duplicates
from loomline.llm.privacy import ENTITIES, KINDS, TERM, find_private, span_text
from loomline.llm.quality_model import score_quality, train_quality_model
from loomline.llm.quality_rules import apply_quality_rules
from loomline.llm.resampling import importance_resample
from loomline.llm.scratch import new_path
from loomline.llm.sharding import shard_documents
from loomline.llm.spelling import corpus_words, spelling_groups
from loomline.llm.store import read_digests, write_store
from loomline.llm.tokens import count_tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: three-word shingles, Jaccard similarity of 0.85 or more."""
    return near_duplicates(_documents(spark, sf_dir), shingle=3, percent=85).drop("text_hash")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out third."""
    docs = _documents(spark, sf_dir)
    model = train_language_model(docs.where(fold_of("doc_id", 3) != 1))
    return identify_language(docs, model).withColumn("held_out", fold_of("doc_id", 3) == 1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds 1024 tokens."""
    counts = count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, row counts at most one apart."""
    return shard_documents(_documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix to source weights takes."""
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans by pattern, and terms that disclose an entity."""
    counts = {k: F.size(k).cast("long") for k in (*ENTITIES, TERM)}
    return find_private(_documents(spark, sf_dir)).select(
        "doc_id",
        *(n.alias(f"n_{k}") for k, n in counts.items()),
        reduce(lambda a, b: a + b, (counts[k] for k in ENTITIES)).alias("n_private"),
        F.sha2(span_text(KINDS), 256).alias("base_sha256"),
        span_text((*ENTITIES, TERM)).alias("spans"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the learned decision list."""
    ruled = apply_quality_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written as a content-addressed store and read back."""
    path = new_path(spark, "token-store")
    write_store(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, path).withColumnRenamed("id", "doc_id")


def op9_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out quarter."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality_model(docs, labels.where(fold_of("doc_id", 4) != 2))
    scored = score_quality(docs, model).withColumn("held_out", fold_of("doc_id", 4) == 2)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with the item and how well it matches."""
    return find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of twenty words or more, drawn towards the benchmark by the gains of their words."""
    return importance_resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=1)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the text decoded from them, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = decode_documents(encode_documents(_documents(spark, sf_dir), path), path)
    return decoded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents, one run in 31 misspelt."""
    return spelling_groups(corpus_words(_documents(spark, sf_dir), drop_every=31))


QUERIES = {f.__name__: f for f in (op10_decontamination, op6_private_data, op7_quality_rules, op2_language, op9_quality_score, op8_token_store, op3_token_counts, op1_near_duplicates, op4_sharding, op5_mixing, op11_resampling, op12_bpe, op13_spelling)}
#: Near-duplicates from the full sets: all linked pairs, then the smallest id reachable.
OP1_SQL = """WITH RECURSIVE
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.low WHERE e.b <> r.node)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(low) AS component_id, min(low) = d.doc_id AS kept
FROM documents d JOIN reach ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a SQL text, by the column ``entries`` of ``crc_table``, the 256 entries of a byte."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1])), 4294967295)"


CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS entries FROM range(256) t(b))"""

OP11_SQL = f"""WITH {CRC_TABLE},
words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
target AS (SELECT unnest(regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM benchmark),
found AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM words) GROUP BY ALL),
buckets AS (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM found UNION SELECT word FROM target), crc_table),
s AS (SELECT bucket, sum(n) AS s FROM found JOIN buckets USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (word) GROUP BY 1),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS gain FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT doc_id, sum(n * gain) AS weight FROM found JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, n_features >= 20 AS open, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM scored)
SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN open AND place <= 10 * many // 100 THEN place END AS rank FROM ranked"""

#: Near words share what is left without one code point; a replacement leaves it at the same place.
OP13_SQL = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
hashed AS (SELECT run, {crc32_sql("(doc_id || ':' || run)")} AS h FROM runs, crc_table WHERE length(run) >= 7),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM spelt WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
parts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM parts a JOIN parts b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, p.word, p.n FROM words w JOIN parts p ON w.word = p.part UNION SELECT p.word, w.word, w.n FROM words w JOIN parts p ON w.word = p.part),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk(word, tip) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.tip WHERE form IS NOT NULL)
SELECT f.word, f.form, w.tip AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN walk w USING (word) JOIN forms e ON e.word = w.tip WHERE e.form IS NULL"""

ORACLE_SQL: dict[str, str] = {"op1_near_duplicates": OP1_SQL, "op11_resampling": OP11_SQL, "op13_spelling": OP13_SQL}
