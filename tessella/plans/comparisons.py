"""Variants of a search over stored candidates, fingerprints of tables, manifests, blocks that say something new, and pages without furniture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import blocks, chunking
from tessella.operators import dense, digests, furniture, fusion, lexical, variants
from tessella.sources.checkpoints import checkpointed
from tessella.sources.tables import table

from .pairs import Family
from .retrieval import _WORDS, BM25, _bm25, _questions

FAMILY = Family()
MOST, WINDOW = 20, 8
VARIANTS = [("text", "text", 1.0, MOST), ("vector", "vector", 1.0, MOST), ("both", "text", 1.0, MOST), ("both", "vector", 1.0, MOST), ("mostly_text", "text", 1.5, MOST), ("mostly_text", "vector", 0.5, MOST), ("short", "text", 0.5, 10), ("short", "vector", 1.0, 10)]


def _alike(spark: SparkSession, folder: str) -> DataFrame:
    return variants.nearest_texts(_questions(spark, folder), table(spark, folder, "documents"), MOST)


_counted = f"SELECT side, id, word, count(*) AS n FROM (SELECT 0 AS side, doc_id AS id, unnest({_WORDS}) AS word FROM documents UNION ALL SELECT 1, item_id, unnest({_WORDS}) FROM benchmark) GROUP BY ALL"
ALIKE = f"""wv AS (SELECT side, id, ('0x' || substr(md5(word), 1, 4))::INT % {variants.SIZE} AS place, sum(CASE WHEN substr(md5(word), 5, 1) <= '7' THEN 1 ELSE -1 END * ln(1 + n::DOUBLE)) AS v FROM ({_counted}) GROUP BY ALL),
wn AS (SELECT side, id, sqrt(sum(v * v)) AS norm FROM wv GROUP BY ALL),
wd AS (SELECT a.id AS item_id, b.id AS doc_id, sum(a.v * b.v) AS dot FROM wv a JOIN wv b ON a.side = 1 AND b.side = 0 AND a.place = b.place GROUP BY ALL),
ws AS (SELECT item_id, doc_id, round(dot / (a.norm * b.norm), 9) AS score FROM wd JOIN wn a ON a.side = 1 AND a.id = item_id JOIN wn b ON b.side = 0 AND b.id = doc_id),
alike AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ws QUALIFY rank <= {MOST})"""
FAMILY.add("text_vectors_topk", lambda s, f: _alike(s, f).select("item_id", "doc_id", "rank", dense.rounded(F.col("score"), 6).alias("score")), f"WITH {ALIKE} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM alike")


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """The text and the vector channel of whole items among whole documents, the vector channel at half the weight."""
    return fusion.reciprocal_rank([(_bm25(spark, folder, MOST), 1.0), (_alike(spark, folder), 0.5)], "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 9).alias("score"))


FAMILY.add("rrf_fusion", rrf_fusion, f"WITH {BM25}, {ALIKE}, u AS (SELECT item_id, doc_id, 1e0 / (59 + rank) AS part FROM hits WHERE rank <= {MOST} UNION ALL SELECT item_id, doc_id, 0.5e0 / (59 + rank) FROM alike) SELECT item_id, doc_id, round(sum(part), 9) AS score FROM u GROUP BY ALL")


def _relevant(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have a run of eight words in common with an item."""

    def runs(rows: DataFrame, key: str) -> DataFrame:
        split = rows.select(key, lexical.words(F.col("text")).alias("w")).where(F.size("w") >= WINDOW)
        hashed = F.transform(F.sequence(F.lit(1), F.size("w") - WINDOW + 1), lambda i: F.md5(F.array_join(F.slice("w", i, WINDOW), " ")))
        return split.select(key, F.explode(F.array_distinct(hashed)).alias("run"))

    return runs(_questions(spark, folder), "item_id").join(runs(table(spark, folder, "documents"), "doc_id"), "run").select(F.col("item_id").alias("query"), F.col("doc_id").alias("id")).distinct()


def _compared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The results of all variants over candidates that are found and stored once, what is relevant, and the variants."""
    few = spark.createDataFrame(VARIANTS, "variant string, channel string, weight double, most int")
    named = lambda rows, channel: rows.select(F.col("item_id").alias("query"), F.lit(channel).alias("channel"), F.col("doc_id").alias("id"), "rank")
    candidates = checkpointed(named(_bm25(spark, folder, MOST), "text").union(named(_alike(spark, folder), "vector")))
    return variants.fused(candidates, few), checkpointed(_relevant(spark, folder)), few


def variant_tallies(spark: SparkSession, folder: str) -> DataFrame:
    results, relevant, few = _compared(spark, folder)
    return variants.compared(checkpointed(variants.hits(results, relevant, few)), "text")


def variant_budgets(spark: SparkSession, folder: str) -> DataFrame:
    results, relevant, _ = _compared(spark, folder)
    sizes = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.char_length("text").cast("long").alias("size"))
    return variants.within_budget(results, sizes, relevant, [4, 8], [3000, 12000])


_values = ", ".join(f"('{v}', '{c}', {w}e0, {m})" for v, c, w, m in VARIANTS)
_runs = "list_distinct(list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i + 7], ' '))))"
COMPARED = f"""{BM25}, {ALIKE}, few(variant, channel, weight, most) AS (VALUES {_values}),
candidates AS (SELECT item_id AS query, 'text' AS channel, doc_id AS id, rank FROM hits WHERE rank <= {MOST} UNION ALL SELECT item_id, 'vector', doc_id, rank FROM alike),
fused AS (SELECT variant, query, id, round(sum(weight / (59 + rank)), 12) AS score FROM candidates JOIN few USING (channel) WHERE rank <= most GROUP BY ALL),
results AS (SELECT *, row_number() OVER (PARTITION BY variant, query ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= {variants.FINAL}),
cut AS (SELECT 0 AS side, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT 1, item_id, {_WORDS} FROM benchmark), runs AS (SELECT side, id, unnest({_runs}) AS run FROM cut WHERE len(w) >= {WINDOW}),
relevant AS (SELECT DISTINCT a.id AS query, b.id AS id FROM runs a JOIN runs b ON a.side = 1 AND b.side = 0 AND a.run = b.run),
judged AS (SELECT v.variant, r.query, max(CASE WHEN s.id IS NULL THEN 0 ELSE 1 END) AS hit FROM (SELECT DISTINCT variant FROM few) v, relevant r LEFT JOIN results s ON s.variant = v.variant AND s.query = r.query AND s.id = r.id GROUP BY ALL)"""
FAMILY.add(
    "variant_tallies",
    variant_tallies,
    f"""WITH {COMPARED}, t AS (SELECT j.variant, count(*) AS n, sum(j.hit)::BIGINT AS hits, sum((j.hit > b.hit)::INT)::BIGINT AS wins, sum((j.hit < b.hit)::INT)::BIGINT AS losses FROM judged j JOIN judged b ON b.variant = 'text' AND b.query = j.query GROUP BY j.variant)
SELECT *, round(least(1e0, list_sum(list_transform(list_filter(range(0, wins + losses + 1), lambda i: abs(2 * i - wins - losses) >= abs(wins - losses)), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2e0))))), 9) AS p FROM t""",
)
FAMILY.add(
    "variant_budgets",
    variant_budgets,
    f"""WITH {COMPARED}, sized AS (SELECT s.variant, s.query, s.rank, length(d.text) + 200 AS size, r.id IS NOT NULL AS good FROM results s JOIN documents d ON d.doc_id = s.id LEFT JOIN relevant r ON r.query = s.query AND r.id = s.id),
listed AS (SELECT variant, query, most, budget, list({{'used': size, 'good': good}} ORDER BY rank) AS l FROM sized, (VALUES (4), (8)) m(most), (VALUES (3000), (12000)) b(budget) WHERE rank <= most AND query IN (SELECT query FROM relevant) GROUP BY ALL),
packed AS (SELECT variant, most, budget, list_reduce(list_prepend({{'used': 0::BIGINT, 'good': false}}, l), lambda a, x: CASE WHEN a.used + x.used > budget THEN a ELSE {{'used': a.used + x.used, 'good': a.good OR x.good}} END).good AS good FROM listed)
SELECT variant, most, budget, count(*) AS n, count(*) FILTER (good) AS hits FROM packed GROUP BY ALL""",
)

_COLUMNS = ["doc_id", "lang", "n_chars", "source", "text"]
FAMILY.add("table_digests", lambda s, f: digests.table_digest(table(s, f, "documents"), by=("lang",)).select("lang", "n", "a", "b", "digest"), f"""WITH d AS (SELECT lang, sha256({" || ".join(f"coalesce('v' || strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, 'n')" for c in _COLUMNS if c != "lang")}) AS d FROM documents),
s AS (SELECT lang, count(*) AS n, (sum(('0x' || substr(d, 1, 15))::BIGINT::HUGEINT) % {digests.PRIMES[0]})::BIGINT AS a, (sum(('0x' || substr(d, 16, 15))::BIGINT::HUGEINT) % {digests.PRIMES[1]})::BIGINT AS b FROM d GROUP BY lang)
SELECT *, sha256(n || '|' || a || '|' || b) AS digest FROM s""")  # fmt: skip


def _manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents now, and before: without every ninth, every seventh edited and every eleventh from elsewhere."""
    docs = table(spark, folder, "documents")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat(F.substring("text", 2, 1 << 30), F.lit("x"))).otherwise(F.col("text"))
    now = digests.manifest(docs.where("doc_id % 10 <> 3"), "doc_id", {"family": "source", "body_sha256": F.sha2("text", 256)})
    before = docs.where("doc_id % 9 <> 0").withColumn("source", F.when(F.col("doc_id") % 11 == 0, "elsewhere").otherwise(F.col("source")))
    return now, digests.manifest(before, "doc_id", {"family": "source", "body_sha256": F.sha2(edited, 256)})


FAMILY.add("manifest_diff", lambda s, f: digests.changes(*_manifests(s, f)), """WITH n AS (SELECT doc_id::VARCHAR AS id, source AS family, sha256(text) AS body FROM documents WHERE doc_id % 10 <> 3),
o AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 11 = 0 THEN 'elsewhere' ELSE source END AS family, sha256(CASE WHEN doc_id % 7 = 0 THEN substr(text, 2) || 'x' ELSE text END) AS body FROM documents WHERE doc_id % 9 <> 0),
j AS (SELECT coalesce(n.id, o.id) AS id, n.id AS ni, o.id AS oi, n.family AS nf, o.family AS of_, n.body AS nb, o.body AS ob FROM n FULL JOIN o ON n.id = o.id)
SELECT id, CASE WHEN oi IS NULL THEN 'added' ELSE 'removed' END AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS baseline, NULL::VARCHAR AS current FROM j WHERE oi IS NULL OR ni IS NULL
UNION ALL SELECT id, 'changed', 'family', of_, nf FROM j WHERE ni IS NOT NULL AND oi IS NOT NULL AND nf IS DISTINCT FROM of_
UNION ALL SELECT id, 'changed', 'body_sha256', ob, nb FROM j WHERE ni IS NOT NULL AND oi IS NOT NULL AND nb IS DISTINCT FROM ob""")  # fmt: skip


def _supplements(spark: SparkSession, folder: str) -> DataFrame:
    """Each document beside the next one of its source and the first of its own sentences, as blocks."""
    docs = chunking.spread(table(spark, folder, "documents")).select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n").alias("text"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(following, "doc_id").select("doc_id", F.concat("text", F.lit("\n\n# A heading\n\nshort one")).alias("full"), F.concat("other", F.lit("\n\n"), "text", F.lit("\n\n# A Heading\n\n# Another heading\n\n"), "other").alias("more"))


_blocks = lambda t: f"list_filter(list_transform(string_split_regex({t}, '\\n\\s*\\n'), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')), lambda b: b <> '')"
_key = lambda b: f"lower(trim(regexp_replace(regexp_replace(regexp_replace({b}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[`*_>#|~]', ' ', 'g'), '\\s+', ' ', 'g')))"
_words_of = lambda k: f"list_distinct(regexp_extract_all({k}, '[\\p{{L}}\\p{{N}}]+(?:[’''\\-][\\p{{L}}\\p{{N}}]+)*'))"
_line = "chr(10) || chr(10)"
BLOCKS = f"""d AS (SELECT doc_id, regexp_replace(text, '\\. ', '.' || {_line}, 'g') AS t FROM documents),
p AS (SELECT a.doc_id, a.t || {_line} || '# A heading' || {_line} || 'short one' AS whole, b.t || {_line} || a.t || {_line} || '# A Heading' || {_line} || '# Another heading' || {_line} || b.t AS more FROM d a JOIN d b ON b.doc_id = a.doc_id + 1),
f AS (SELECT doc_id, list_transform({_blocks("whole")}, lambda b: {_key("b")}) AS have, {_blocks("more")} AS mb FROM p),
c AS (SELECT doc_id, have, list_distinct(flatten(list_transform(have, lambda k: {_words_of("k")}))) AS cover, mb FROM f),
e AS (SELECT doc_id, have, cover, unnest(mb) AS block, generate_subscripts(mb, 1) AS pos FROM c),
x AS (SELECT *, {_key("block")} AS key, regexp_matches(block, '^\\s*(#|[-*+>] )') OR len(list_filter(string_split(block, chr(10)), lambda l: starts_with(ltrim(l), '|'))) >= 2 AS own FROM e),
w AS (SELECT *, {_words_of("key")} AS w FROM x)"""
FAMILY.add(
    "supplemental_blocks",
    lambda s, f: _supplements(s, f).select("doc_id", F.posexplode(blocks.supplemental(F.col("full"), F.col("more"))).alias("place", "block")),
    f"""WITH {BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS r FROM w WHERE len(w) > 0 AND NOT list_contains(have, key) AND len(list_intersect(w, cover)) / len(w) < CASE WHEN own THEN 0.98 ELSE 0.90 END AND (len(w) >= 4 OR own))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS place, block FROM n WHERE r = 1 QUALIFY place < 80""",
)
FAMILY.add(
    "blocks_without_repeats",
    lambda s, f: _supplements(s, f).select("doc_id", F.size(blocks.without_repeats(F.col("more"))).alias("n"), F.md5(F.array_join(blocks.without_repeats(F.col("more")), "\n\n")).alias("digest")),
    f"""WITH {BLOCKS}, v AS (SELECT doc_id, word, min(pos) AS pos FROM (SELECT doc_id, pos, unnest(w) AS word FROM w) GROUP BY ALL), fresh AS (SELECT DISTINCT doc_id, pos FROM v),
k AS (SELECT w.*, f.pos IS NOT NULL AS news, min(w.pos) OVER (PARTITION BY w.doc_id, key) AS first FROM w LEFT JOIN fresh f ON f.doc_id = w.doc_id AND f.pos = w.pos)
SELECT doc_id, count(*)::INT AS n, md5(string_agg(block, {_line} ORDER BY pos)) AS digest FROM k WHERE NOT ((key <> '' AND pos <> first) OR (NOT own AND len(w) >= 2 AND NOT news)) GROUP BY doc_id""",
)


def _paged(spark: SparkSession, folder: str) -> DataFrame:
    """Ten documents at a time as the pages of one, with a running head, a foot and numbers."""
    docs = table(spark, folder, "documents")
    document, page = F.floor(F.col("doc_id") / 10).cast("long"), (F.col("doc_id") % 10).cast("int")
    head = F.concat(F.lit("ANNUAL REPORT "), F.col("lang"), F.lit(" | "), (page + 1).cast("string"))
    foot = F.when(document % 2 == 0, F.concat(F.lit("- "), (page + 7).cast("string"), F.lit(" -"))).otherwise("www.example.com")
    return docs.select(document.alias("document"), page.alias("page"), F.concat_ws("\n", head, F.lit(""), "text", F.lit(""), foot).alias("text"))


def pages_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return furniture.cleaned_pages(_paged(spark, folder)).select("document", "page", "removed", F.char_length("text").alias("characters"), F.md5("text").alias("digest"))


def documents_assembled(spark: SparkSession, folder: str) -> DataFrame:
    pages = furniture.cleaned_pages(_paged(spark, folder))
    titles = pages.select("document").distinct().withColumn("title", F.concat(F.lit("Report "), F.col("document").cast("string")))
    return furniture.assembled(pages, titles).select("document", "pages", "words", "usable", F.md5("text").alias("digest"))


FAMILY.add("pages_cleaned", pages_cleaned)
FAMILY.add("documents_assembled", documents_assembled)
