"""Search, fusion, reranking, packing and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import dense, fusion, lexical, metrics
from tessella.sources.tables import table

from .pairs import Family

FAMILY = Family()
_COSINE = "round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9)"
TOP = f"""pairs AS (
  SELECT q.vec_id AS query, v.vec_id, q.label AS want, v.label AS got, {_COSINE} AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM pairs
)"""


def _dense(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return dense.top_k(vectors.where("vec_id % 50 = 0"), vectors, k)


FAMILY.add("dense_topk", lambda s, f: _dense(s, f).select("query", "vec_id", "rank", F.round("score", 6).alias("score")), f"WITH {TOP} SELECT query, vec_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    hits = _dense(spark, folder).join(labels.withColumnRenamed("label", "got"), "vec_id").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("want")), "query")
    totals = labels.groupBy("label").count()
    total = labels.where("vec_id % 50 = 0").join(totals, "label").select(F.col("vec_id").alias("query"), (F.col("count") - 1).alias("total"))
    return metrics.ranking_metrics(hits.withColumn("gain", (F.col("got") == F.col("want")).cast("int")), total, "query")


def dense_topk_metrics(spark: SparkSession, folder: str) -> DataFrame:
    names = [f"{m}{k}" for k in metrics.CUTOFFS for m in ("p", "recall", "hit", "rr", "ap", "ndcg")]
    return _judged(spark, folder).agg(*[F.round(F.avg(n), 6).alias(n) for n in names])


def _metric_sql() -> str:
    parts = []
    for k in metrics.CUTOFFS:
        ideal = f"list_sum(list_transform(range(1, greatest(1, least({k}, total)) + 1), lambda i: 1 / log2(i + 1)))"
        parts += [
            f"sum(hit) FILTER (rank <= {k}) / greatest(1, count(*) FILTER (rank <= {k})) AS p{k}", f"CASE WHEN any_value(total) > 0 THEN sum(hit) FILTER (rank <= {k}) / any_value(total) ELSE 0 END AS recall{k}",
            f"CASE WHEN sum(hit) FILTER (rank <= {k}) > 0 THEN 1.0 ELSE 0 END AS hit{k}", f"coalesce(max(hit / rank) FILTER (rank <= {k}), 0) AS rr{k}",
            f"CASE WHEN any_value(total) > 0 THEN sum(hit * seen / rank) FILTER (rank <= {k}) / least(any_value(total), {k}) ELSE 0 END AS ap{k}",
            f"CASE WHEN any_value(total) > 0 THEN sum(hit / log2(rank + 1)) FILTER (rank <= {k}) / any_value({ideal}) ELSE 0 END AS ndcg{k}",
        ]
    return ", ".join(parts)


PER_QUERY = f"""{TOP}, totals AS (SELECT label, count(*) - 1 AS total FROM embeddings GROUP BY label), judged AS (
  SELECT query, rank, (want = got)::INT AS hit, sum((want = got)::INT) OVER (PARTITION BY query ORDER BY rank) AS seen, total FROM ranked JOIN totals ON label = want WHERE rank <= 10
), per AS (SELECT query, {_metric_sql()} FROM judged GROUP BY query)"""
FAMILY.add("dense_topk_metrics", dense_topk_metrics, f"WITH {PER_QUERY} SELECT " + ", ".join(f"round(avg({m}{k}), 6) AS {m}{k}" for k in metrics.CUTOFFS for m in ("p", "recall", "hit", "rr", "ap", "ndcg")) + " FROM per")
FAMILY.add("dense_per_query", lambda s, f: _judged(s, f).select("query", *[F.round(c, 6).alias(c) for c in ("p5", "recall10", "rr10", "ap10", "ndcg10")]), f"WITH {PER_QUERY} SELECT query, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("p5", "recall10", "rr10", "ap10", "ndcg10")) + " FROM per")

_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
BM25 = f"""q AS (SELECT item_id, text FROM benchmark),
terms AS (SELECT item_id, word, count(*) AS qf FROM (SELECT item_id, unnest({_WORDS}) AS word FROM q) GROUP BY ALL),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), lengths AS (SELECT doc_id, len(w) AS length FROM d), mean AS (SELECT count(*) AS n, avg(length) AS m FROM lengths),
postings AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM terms) GROUP BY ALL),
freq AS (SELECT word, count(*) AS df FROM postings GROUP BY word),
bm AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * qf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * length / m))), 9) AS score FROM terms JOIN freq USING (word) JOIN postings USING (word) JOIN lengths USING (doc_id), mean GROUP BY item_id, doc_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select("item_id", "text")


def _bm25(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    return lexical.bm25(_questions(spark, folder), table(spark, folder, "documents"), k)


def _with_texts(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return _bm25(spark, folder, k).join(_questions(spark, folder).withColumnRenamed("text", "question"), "item_id").join(docs, "doc_id")


FAMILY.add("bm25_topk", lambda s, f: _bm25(s, f).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score")), f"WITH {BM25} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM hits WHERE rank <= 10")


FAMILY.add("linear_fusion", lambda s, f: fusion.linear_decay([(_bm25(s, f), 1.0)], "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 9).alias("score")), f"WITH {BM25}, t AS (SELECT * FROM hits WHERE rank <= 10) SELECT item_id, doc_id, round(greatest(0.001e0, (count(*) OVER (PARTITION BY item_id) - rank + 1)::DOUBLE / count(*) OVER (PARTITION BY item_id)), 9) AS score FROM t")
_stop = "[" + ", ".join(f"'{w}'" for w in fusion.STOPWORDS) + "]"


def idf_weights(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "conversations").select("conv_id", "turn", F.round(fusion.rarity(text), 6).alias("rarity"), F.round(fusion.channel_weights(text).vector, 6).alias("vector"), F.round(fusion.channel_weights(text).text, 6).alias("lexical"))


FAMILY.add("idf_weights", idf_weights, f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations), c AS (SELECT *, list_filter(w, lambda x: NOT list_contains({_stop}, x)) AS k, len(w) AS n FROM t),
r AS (SELECT conv_id, turn, n, least(1e0, CASE WHEN len(k) > 0 THEN len(list_distinct(k))::DOUBLE / len(k) ELSE 0 END * 0.6e0 + least(1e0, CASE WHEN len(k) > 0 THEN list_sum(list_transform(k, lambda x: length(x)))::DOUBLE / len(k) ELSE 0 END / 8) * 0.4e0) AS r FROM c)
SELECT conv_id, turn, round(r, 6) AS rarity, round(CASE WHEN n = 0 THEN 1.5 WHEN n < 5 THEN CASE WHEN r > 0.7 THEN 1.2 ELSE 1.5 END WHEN n <= 15 THEN 1.5e0 - r * 0.5e0 WHEN r < 0.3 THEN 1.0 ELSE 0.5 END, 6) AS vector,
round(CASE WHEN n = 0 THEN 0.5 WHEN n < 5 THEN CASE WHEN r > 0.7 THEN 0.8 ELSE 0.5 END WHEN n <= 15 THEN 0.5e0 + r * 0.5e0 WHEN r < 0.3 THEN 1.0 ELSE 1.5 END, 6) AS lexical FROM r""")
HYDRATED = f"{BM25}, h AS (SELECT h.item_id, h.doc_id, h.rank, q.text AS question, d.text FROM hits h JOIN q USING (item_id) JOIN documents d USING (doc_id) WHERE h.rank <= 10)"
FAMILY.add("rerank_first_tier", lambda s, f: fusion.rerank(_with_texts(s, f), "item_id", "doc_id", "question", "text"), f"""WITH {HYDRATED}, w AS (SELECT item_id, doc_id, rank, list_distinct({_WORDS.replace('text', 'question')}) AS a, list_distinct({_WORDS}) AS b FROM h),
o AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END AS o FROM w), c AS (SELECT *, round(0.6e0 * o + 0.4e0 * (1 - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY item_id)), 9) AS c, max(o) OVER (PARTITION BY item_id) >= 0.1 AS any_ok FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN any_ok THEN -c ELSE rank END, rank) AS place FROM c WHERE NOT any_ok OR o >= 0.1) SELECT item_id, doc_id, c AS score, place FROM p WHERE place <= 4""")
FAMILY.add("near_duplicate_hits", lambda s, f: fusion.without_near_duplicates(_with_texts(s, f), "item_id", "doc_id", "text").select("item_id", F.array_join("keys", ",").alias("keys")))
FAMILY.add("packed_context", lambda s, f: fusion.packed_context(_with_texts(s, f).withColumn("size", F.length("text") + 50), "item_id", "doc_id", "size", 12000).select("item_id", F.array_join("keys", ",").alias("keys")),
    f"""WITH {HYDRATED}, l AS (SELECT item_id, list({{'k': doc_id::VARCHAR, 's': length(text) + 50}} ORDER BY rank) AS l FROM h GROUP BY item_id),
f AS (SELECT item_id, list_reduce(list_transform(l, lambda x: {{'k': [x.k], 's': x.s}}), lambda a, x: CASE WHEN a.s + x.s > 12000 THEN a ELSE {{'k': list_concat(a.k, x.k), 's': a.s + x.s}} END, {{'k': []::VARCHAR[], 's': 0::BIGINT}}).k AS k FROM l)
SELECT item_id, array_to_string(list_concat(list_filter(k, lambda x, i: i % 2 = 1), list_reverse(list_filter(k, lambda x, i: i % 2 = 0))), ',') AS keys FROM f""")
FAMILY.add("lexical_recall", lambda s, f: _bm25(s, f).groupBy("item_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best")), f"WITH {BM25} SELECT item_id, count(*) AS hits, round(max(score), 6) AS best FROM hits WHERE rank <= 10 GROUP BY item_id")
FAMILY.add("best_per_source", lambda s, f: _bm25(s, f, 20).join(table(s, f, "documents").select("doc_id", "source"), "doc_id").groupBy("item_id", "source").agg(F.round(F.max("score"), 6).alias("best")), f"WITH {BM25} SELECT item_id, source, round(max(score), 6) AS best FROM hits JOIN documents USING (doc_id) WHERE rank <= 20 GROUP BY ALL")


def bootstrap_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.bootstrap_mean(_judged(spark, folder).withColumn("strategy", F.lit("dense")), "strategy", "query", "ndcg10")


def paired_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """nDCG of the first ten hits against that of the first five."""
    return metrics.paired_bootstrap(_judged(spark, folder).withColumn("strategy", F.lit("ndcg5 to ndcg10")), "strategy", "query", "ndcg5", "ndcg10")


FAMILY.add("bootstrap_ndcg", bootstrap_ndcg)
FAMILY.add("paired_bootstrap", paired_bootstrap)
