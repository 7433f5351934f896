"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, exact_dedup, fingerprints, license_scan, license_texts, mixing, ngram_join, pii, resampling, secret_scan, sharding, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, table(spark, d, "labels"))
    return toxicity.score(docs, model).select(
        F.col("_id").alias("doc_id"), toxicity.held_out("_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )


@query
def op9_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = exact_dedup.duplicates(table(spark, d, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


ORACLES["op9_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
     k AS (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


@query
def op10_bpe(spark: SparkSession, d: str) -> DataFrame:
    rows = bpe.encode(table(spark, d, "documents"), bpe.vocabulary("byte_bpe_50k.json"))
    return rows.withColumnRenamed("_id", "doc_id")


@query
def op8_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, d, "documents")).withColumnRenamed("_id", "doc_id")


#: Domains of op5: documents of low and of high quality; their target weights.
QUALITY_WEIGHTS = (0.1, 0.9)


@query
def op5_mixing(spark: SparkSession, d: str) -> DataFrame:
    rows = mixing.mix(table(spark, d, "documents"), table(spark, d, "labels"), F.col("quality"), QUALITY_WEIGHTS)
    return rows.select(
        F.col("_id").alias("doc_id"), "n_words", F.col("p")[0].alias("p_low"), F.col("p")[1].alias("p_high"), "rate",
        mixing.draw().cast("long").alias("copies"),
    )


@query
def op2_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, d, "documents")).withColumnRenamed("_id", "doc_id")


@query
def op3_sharding(spark: SparkSession, d: str) -> DataFrame:
    rows = sharding.shard(table(spark, d, "documents"), 16)
    return rows.select(
        F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op4_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, d, "documents")).withColumnRenamed("_id", "doc_id")


@query
def op6_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.secrets(table(spark, d, "documents")).withColumnRenamed("_id", "doc_id")


@query
def op1_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.licenses(table(spark, d, "documents"), license_texts.every()).withColumnRenamed("_id", "doc_id")


@query
def op11_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark")).withColumnRenamed("_id", "doc_id")


@query
def op12_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(table(spark, d, "documents")).withColumnRenamed("_id", "doc_id")


@query
def op13_centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroids.cluster(table(spark, d, "embeddings")).withColumnRenamed("_id", "vec_id")


#: Words of documents with their numbers, and what follows a word.
_WORDS = r"""
d AS (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d)"""


def _following(n: int) -> str:
    return " || ' ' || ".join(["t", *[f"lead(t, {k}) OVER o" for k in range(1, n)]])


ORACLES["op4_substring_dedup"] = f"""
WITH {_WORDS.format(text="coalesce(text, '')")},
windows AS (SELECT doc_id, i, {_following(13)} AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
firsts AS (SELECT g, min(doc_id) AS least FROM windows WHERE g IS NOT NULL GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN firsts USING (g), range(13) AS r(k) WHERE least < doc_id),
kept AS (SELECT doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(t, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS left_over
         FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op8_ngram_join"] = f"""
WITH RECURSIVE {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
shingles AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, {_following(5)} AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, s.b FROM reached r JOIN both_ways s ON s.a = r.other),
least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

#: SQL text of a floored quotient of whole numbers.
_FLOORED = "(({a}) - ((({a}) % {b}) + {b}) % {b}) // {b}"


def _words_in(table_name: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table_name}"


ORACLES["op11_resampling"] = f"""
WITH bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
              FROM (SELECT unnest(range(256))::BIGINT AS i)),
crcs AS (SELECT list(x ORDER BY i) AS crc FROM bits),
d AS (SELECT doc_id, {_words_in("documents")}),
corpus AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) GROUP BY t),
target AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM (SELECT {_words_in("benchmark")})) GROUP BY t),
spelt AS (SELECT t, list_transform(range(strlen(t)), lambda k: ('0x' || substr(hex(t), 2 * k + 1, 2))::BIGINT) AS b FROM (SELECT t FROM corpus UNION SELECT t FROM target)),
hashed AS (SELECT t, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelt, crcs),
s AS (SELECT bucket, sum(n)::DOUBLE AS n FROM corpus JOIN hashed USING (t) GROUP BY bucket),
g AS (SELECT bucket, sum(n)::DOUBLE AS n FROM target JOIN hashed USING (t) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(g.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
                                   / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM g) + 10000))))::BIGINT AS gain FROM s LEFT JOIN g USING (bucket)),
weighed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM (SELECT doc_id, unnest(w) AS t FROM d) JOIN hashed USING (t) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce({_FLOORED.format(a="total", b="n")}, 0) AS weight,
                  ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN weighed USING (doc_id)),
drawn AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM drawn WHERE n_features >= 20)
SELECT drawn.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM drawn LEFT JOIN ranked USING (doc_id)
"""


def _round(n: int) -> str:
    """SQL text of assigning all vectors to the centroids of a round, and of those of the next."""
    return f"""
a{n} AS (SELECT vec_id, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}}) AS best
        FROM v, c{n} GROUP BY vec_id),
t{n} AS (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY c, i),
m{n} AS (SELECT c, list(({_FLOORED.format(a="s", b="n")})::BIGINT ORDER BY i) AS m FROM t{n} GROUP BY c),
c{n + 1} AS (SELECT c, coalesce(m{n}.m, c{n}.m) AS m FROM c{n} LEFT JOIN m{n} USING (c)),"""


ORACLES["op13_centroids"] = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS m FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)),
{"".join(map(_round, range(4))).rstrip(",")}
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = best.c
"""
