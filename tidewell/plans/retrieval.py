"""Retrieval queries: vectors, words, fusion, diversity and projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import ranked, vectors
from tidewell.plans.registry import query
from tidewell.session import table

TERMS = ["audit", "office", "lease"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("silo"), "embedding")


def _asked(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _near(spark: SparkSession, sf_dir: str, vec_id: int, k: int, metric: str = "cosine") -> DataFrame:
    return vectors.nearest(_vectors(spark, sf_dir), _asked(spark, sf_dir, vec_id), k, metric=metric)


def _words(spark: SparkSession, sf_dir: str, terms: list[str], k: int = 200) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(ranked.any_term("text", terms)).select(F.col("doc_id").alias("id"))
    return ranked.top(docs, k, "id")


def _cos(vec: int, k: int) -> str:
    return f"""SELECT vec_id AS id, CAST(label AS BIGINT) AS silo, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec})), 6) AS dist
      FROM embeddings ORDER BY dist, id LIMIT {k}"""


NEAR = f"near AS (SELECT *, CAST(row_number() OVER (ORDER BY dist, id) - 1 AS BIGINT) AS pos FROM ({_cos(0, 60)}) t)"
LIKE = " OR ".join(f"contains(text, '{t}')" for t in TERMS)
WORDS = f"words AS (SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos FROM documents WHERE {LIKE} ORDER BY doc_id LIMIT 200)"
FUSED = """fused AS (SELECT coalesce(n.id, w.id) AS id, n.dist, n.pos + 1 AS vector_rank, w.pos + 1 AS lexical_rank,
  coalesce(1.0::DOUBLE / (60 + n.pos + 1), 0) + coalesce(1.0::DOUBLE / (60 + w.pos + 1), 0) AS rrf_score FROM near n FULL OUTER JOIN words w ON n.id = w.id)"""
FUSED_TOP = """top AS (SELECT *, CAST(row_number() OVER (ORDER BY rrf_score DESC, vector_rank IS NULL, coalesce(vector_rank, lexical_rank)) - 1 AS BIGINT) AS pos FROM fused QUALIFY pos < 60)"""


@query("knn_cosine", f"WITH {NEAR} SELECT id, silo, dist, pos FROM near")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 0, 60)


@query(
    "knn_l2_in_silo",
    """WITH t AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS silo, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 4) AS dist
      FROM embeddings WHERE label = 3 ORDER BY dist, id LIMIT 20) SELECT *, CAST(row_number() OVER (ORDER BY dist, id) - 1 AS BIGINT) AS pos FROM t""",
)
def knn_l2_in_silo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(_vectors(spark, sf_dir), _asked(spark, sf_dir, 0), 20, metric="l2sq", where=F.col("silo") == 3, digits=4)


@query("lexical_any_term", f"WITH {WORDS} SELECT id, pos FROM words")
def lexical_any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, TERMS)


@query("rrf_fusion", f"WITH {NEAR}, {WORDS}, {FUSED}, {FUSED_TOP} SELECT id, dist, vector_rank, lexical_rank, round(rrf_score, 9) AS rrf_score, pos FROM top")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = ranked.reciprocal_rank(_near(spark, sf_dir, 0, 60), _words(spark, sf_dir, TERMS), 60)
    return both.withColumn("rrf_score", F.round("rrf_score", 9))


def _with_documents(spark: SparkSession, sf_dir: str, stream: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "doc_kind")
    return stream.join(docs, "id").withColumn("chunk_hash", F.substring(F.sha2("text", 256), 1, 16))


FULL = f"""WITH {NEAR}, {WORDS}, {FUSED}, {FUSED_TOP},
  told AS (SELECT t.*, d.text, d.source, d.doc_kind, substr(sha256(d.text), 1, 16) AS chunk_hash FROM top t JOIN documents d ON d.doc_id = t.id),
  capped AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(source, ''), '__unknown_' || pos) ORDER BY pos) AS n FROM told QUALIFY n <= 3),
  cut AS (SELECT * FROM capped ORDER BY pos LIMIT 12),
  once AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY pos) AS h FROM cut QUALIFY h = 1)"""


@query(
    "retrieve_hybrid",
    FULL + """ SELECT id, source, chunk_hash, CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS pos, round(greatest(0, 1 - dist), 4) AS score,
      CASE WHEN greatest(0, 1 - dist) >= 0.5 THEN 'high' WHEN greatest(0, 1 - dist) >= 0.2 THEN 'medium' ELSE 'low' END AS confidence FROM once""",
)
def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and words fused, at most three of a source, the first twelve, distinct contents, scored."""
    fused = ranked.reciprocal_rank(_near(spark, sf_dir, 0, 60), _words(spark, sf_dir, TERMS), 60)
    told = ranked.first_of_hash(ranked.cap_per_key(_with_documents(spark, sf_dir, fused), "source", 3, 12))
    score = F.greatest(F.lit(0.0), 1 - F.col("dist"))
    band = F.when(score >= 0.5, "high").when(score >= 0.2, "medium").otherwise("low")
    return told.select("id", "source", "chunk_hash", "pos", F.round(F.when(F.col("dist").isNotNull(), score).otherwise(0.0), 4).alias("score"), F.when(F.col("dist").isNull(), "low").otherwise(band).alias("confidence"))


@query("silo_cap", f"WITH {NEAR}, c AS (SELECT *, row_number() OVER (PARTITION BY silo ORDER BY pos) AS n FROM near QUALIFY n <= 2) SELECT id, silo, dist, CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS pos FROM c ORDER BY pos LIMIT 12")
def silo_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.cap_per_key(_near(spark, sf_dir, 0, 60), "silo", 2, 12).select("id", "silo", "dist", "pos")


@query(
    "min_silo_coverage",
    f"""WITH {NEAR}, m AS (SELECT *, min(coalesce(dist, 999)) OVER (PARTITION BY silo) AS best, row_number() OVER (PARTITION BY silo ORDER BY pos) AS f FROM near),
      r AS (SELECT silo, row_number() OVER (ORDER BY best, pos) AS rk FROM m WHERE f = 1), p AS (SELECT m.*, CASE WHEN f = 1 AND rk <= 3 THEN 0 ELSE 1 END AS late FROM m LEFT JOIN r USING (silo) ORDER BY late, pos LIMIT 6)
      SELECT id, silo, dist, CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS pos FROM p""",
)
def min_silo_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.least_coverage(_near(spark, sf_dir, 0, 60), "silo", 6, 3).select("id", "silo", "dist", "pos")


@query("soft_promotion", f"""WITH {NEAR}, h AS (SELECT * FROM near WHERE pos < 8), l AS (SELECT silo AS lead FROM h GROUP BY silo HAVING count(*) >= 0.25 * 8 ORDER BY count(*) DESC, min(pos) LIMIT 1),
  b AS (SELECT silo, min(dist) AS best FROM near GROUP BY silo), e AS (SELECT silo FROM b, l WHERE silo <> lead AND best <= (SELECT best FROM b, l WHERE silo = lead) + 0.3),
  o AS (SELECT *, row_number() OVER (ORDER BY dist, CAST(silo AS VARCHAR), pos) AS slot FROM (SELECT * FROM near WHERE pos >= 8 AND silo IN (SELECT silo FROM e) QUALIFY row_number() OVER (PARTITION BY silo ORDER BY dist, pos) = 1) QUALIFY slot <= 2),
  s AS (SELECT pos AS place, row_number() OVER (ORDER BY pos DESC) AS slot FROM h, l WHERE silo = lead), w AS (SELECT o.id, o.silo, o.dist, s.place FROM o JOIN s USING (slot)),
  j AS (SELECT id, silo, dist, pos AS place FROM h WHERE pos NOT IN (SELECT place FROM w) UNION ALL SELECT * FROM w) SELECT id, silo, dist, CAST(row_number() OVER (ORDER BY place) - 1 AS BIGINT) AS pos FROM j""")
def soft_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.promote_diversity(_near(spark, sf_dir, 0, 60), "silo", 8, dominance=0.25, margin=0.3).select("id", "silo", "dist", "pos")


@query("relevance_gate", f"WITH {NEAR} SELECT count(dist) > 0 AND min(dist) > 0.9 AS irrelevant, count(dist) AS distances FROM near")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.relevance_gate(_near(spark, sf_dir, 0, 60))


@query(
    "dual_stream_rrf",
    f"""WITH {NEAR}, b AS (SELECT id, silo, dist, pos, 0 AS stream FROM near UNION ALL
        SELECT id, silo, dist, CAST(row_number() OVER (ORDER BY dist, id) - 1 AS BIGINT), 1 FROM ({_cos(5, 40)}) z),
      g AS (SELECT id, silo, sum(1.0::DOUBLE / (61 + pos)) AS s, arg_min(dist, stream) AS dist, min(stream * 1000000 + pos) AS seen, count(DISTINCT stream) AS streams FROM b GROUP BY id, silo)
      SELECT id, silo, dist, streams, round(s, 9) AS rrf_score, CAST(row_number() OVER (ORDER BY s DESC, dist, seen) - 1 AS BIGINT) AS pos FROM g QUALIFY pos < 30""",
)
def dual_stream_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranked.dual_stream(_near(spark, sf_dir, 0, 60), _near(spark, sf_dir, 5, 40), ["id", "silo"], 30)
    return out.withColumn("rrf_score", F.round("rrf_score", 9))


@query(
    "fan_out_by_silo",
    f"""WITH t AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS silo, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS dist FROM embeddings)
      SELECT id, silo, dist, CAST(row_number() OVER (PARTITION BY silo ORDER BY dist, id) AS BIGINT) AS rank_in_silo FROM t QUALIFY rank_in_silo <= 4""",
)
def fan_out_by_silo(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _asked(spark, sf_dir, 0)])
    rows = _vectors(spark, sf_dir).select("id", "silo", F.round(vectors.distance(F.col("embedding"), q), 6).alias("dist"))
    from pyspark.sql import Window as W

    return rows.withColumn("rank_in_silo", F.row_number().over(W.partitionBy("silo").orderBy("dist", "id")).cast("bigint")).where("rank_in_silo <= 4")


@query(
    "candidate_silos",
    f"WITH {NEAR} SELECT silo, min(dist) AS best, min(pos) AS first_pos, count(*) AS hits FROM near GROUP BY silo ORDER BY best, first_pos LIMIT 6",
)
def candidate_silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir, 0, 60)
    return near.groupBy("silo").agg(F.min("dist").alias("best"), F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("hits")).orderBy("best", "first_pos").limit(6)


@query("retrieval_confidence", f"""WITH {NEAR} SELECT round(avg(dist), 6) AS avg_dist, min(dist) AS top_dist, count(DISTINCT silo) AS silos, median(dist) AS median_dist,
  CASE WHEN first(1 - dist ORDER BY pos) >= 0.6 AND avg(1 - dist) >= 0.4 THEN 'high' WHEN first(1 - dist ORDER BY pos) >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM near WHERE pos < 10""")
def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir, 0, 60).where("pos < 10").withColumn("score", 1 - F.col("dist"))
    first, mean = F.min_by("score", "pos"), F.avg("score")
    return near.agg(
        F.round(F.avg("dist"), 6).alias("avg_dist"), F.min("dist").alias("top_dist"), F.count_distinct("silo").alias("silos"), F.median("dist").alias("median_dist"),
        F.when((first >= 0.6) & (mean >= 0.4), "high").when(first >= 0.4, "medium").otherwise("low").alias("level"),
    )


@query("context_budget", f"""WITH RECURSIVE {NEAR}, t AS (SELECT n.id, d.source, row_number() OVER (ORDER BY n.pos) AS i, n.pos, least(length(d.text), 1000) + 8 AS size FROM near n JOIN documents d ON d.doc_id = n.id),
  f AS (SELECT 0 AS i, 0::BIGINT AS used, -1::BIGINT AS id UNION ALL SELECT t.i, CASE WHEN used + size <= 6000 THEN used + size ELSE used END, CASE WHEN used + size <= 6000 THEN t.id ELSE -1 END FROM f JOIN t ON t.i = f.i + 1)
  SELECT t.id, t.source, CAST(row_number() OVER (ORDER BY t.pos) - 1 AS BIGINT) AS pos FROM f JOIN t USING (i) WHERE f.id >= 0""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest texts that fit 6,000 characters, each counted with at most 1,000 and 8 for its frame."""
    told = _with_documents(spark, sf_dir, _near(spark, sf_dir, 0, 60))
    return ranked.skip_greedy_budget(told, F.least(F.length("text"), F.lit(1000)) + 8, 6000).select("id", "source", "pos")


@query("multi_query_merge", f"""WITH q AS (SELECT *, 0::BIGINT AS question_no, CAST(row_number() OVER (ORDER BY dist, id) - 1 AS BIGINT) AS p FROM ({_cos(0, 40)}) z0 UNION ALL SELECT *, 1::BIGINT AS question_no, CAST(row_number() OVER (ORDER BY dist, id) - 1 AS BIGINT) AS p FROM ({_cos(5, 40)}) z1 UNION ALL SELECT *, 2::BIGINT AS question_no, CAST(row_number() OVER (ORDER BY dist, id) - 1 AS BIGINT) AS p FROM ({_cos(9, 40)}) z2), d AS (SELECT q.id, d.source, round(1 - q.dist, 6) AS score, question_no, p, left(d.text, 200) AS h FROM q JOIN documents d ON d.doc_id = q.id QUALIFY row_number() OVER (PARTITION BY h ORDER BY question_no, p) = 1)
  SELECT id, source, score, question_no, count(*) OVER () > 50 AS truncated, CAST(row_number() OVER (ORDER BY score DESC, question_no, p) - 1 AS BIGINT) AS pos FROM d QUALIFY pos < 50""")
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = [_with_documents(spark, sf_dir, _near(spark, sf_dir, v, 40)).withColumn("score", F.round(1 - F.col("dist"), 6)) for v in (0, 5, 9)]
    return ranked.merge_queries(streams, 50).select("id", "source", "score", "question_no", "truncated", "pos")


NOW = 1_600_000_000.0


@query(
    "recency_blend",
    f"""SELECT file_key, round(1.0 / (1 + coalesce(chunk_count, 0)) + 0.15 * CASE WHEN mtime > 0 THEN exp(-0.693 * greatest(0, ({NOW} - mtime) / 86400.0) / 365.0) ELSE 0 END, 6) AS blended
      FROM files ORDER BY blended DESC, file_key LIMIT 50""",
)
def recency_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files")
    recent = F.coalesce(ranked.recency_score(F.col("mtime"), NOW), F.lit(0.0))
    score = F.round(F.lit(1.0) / (1 + F.coalesce("chunk_count", F.lit(0))) + 0.15 * recent, 6)
    return files.select("file_key", score.alias("blended")).orderBy(F.desc("blended"), "file_key").limit(50)


@query(
    "trigger_first",
    """SELECT doc_id, CAST(row_number() OVER (ORDER BY NOT regexp_matches(text, '(?i)signature|heating'), doc_id) - 1 AS BIGINT) AS pos FROM documents QUALIFY pos < 100""",
)
def trigger_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (~F.regexp_like("text", F.lit("(?i)signature|heating"))).alias("late"))
    return ranked.top(docs, 100, "late", "doc_id").select("doc_id", "pos")
