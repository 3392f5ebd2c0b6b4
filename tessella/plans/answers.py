"""Steps of answering runs, results of chunks, and names and quality of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import answers, documents, guards
from tessella.functions.furniture_forms import MARKER, RULE, WORD
from tessella.sources.tables import table

from .knowledge import _quoted
from .pairs import Family

FAMILY = Family()
ADD = FAMILY.add


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = lambda k, value: F.when(F.col("doc_id") % k == 0, value)
    return docs.select(
        "doc_id", found(11, F.col("text")).alias("parent"), found(5, F.array("lang", "source")).alias("dense"), found(3, F.col("source")).alias("words"), found(2, F.lit("")).alias("chunk"), found(7, F.col("text")).alias("contextual"),
        F.when(F.col("doc_id") % 4 == 0, F.col("lang")).when(F.col("doc_id") % 4 == 1, "").alias("summary"),
    )


ADD("best_contents", lambda s, f: _hits(s, f).select("doc_id", F.md5(answers.best_content(*map(F.col, ("parent", "dense", "words", "chunk", "contextual", "summary")))).alias("digest")), """WITH b AS (SELECT doc_id, lang,
  CASE WHEN doc_id % 11 = 0 AND text <> '' THEN text WHEN doc_id % 5 = 0 THEN lang || chr(10) || source WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 2 = 0 THEN '' WHEN doc_id % 7 = 0 THEN text ELSE '' END AS base, CASE doc_id % 4 WHEN 0 THEN lang ELSE '' END AS summary FROM documents)
SELECT doc_id, md5(CASE WHEN summary <> '' AND base <> '' THEN 'Context: ' || summary || chr(10) || chr(10) || base WHEN base <> '' THEN base ELSE summary END) AS digest FROM b""")  # fmt: skip


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda by, *values: F.get(F.array(*map(F.lit, values)), (F.col("event_id") % by).cast("int"))
    given = answers.evidence_input(pick(4, "high", "medium", "low", None), F.col("event_id") % 3 == 0, pick(5, "fresh", "aged", "odd", None, "unknown"), pick(3, "current", "past", None))
    return table(spark, folder, "events").select("event_id", given.alias("e")).select("event_id", "e.*")


ADD("evidence_inputs", _evidence, """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'high_current' WHEN 1 THEN 'medium_current' ELSE 'low_current' END AS query_risk, CASE WHEN event_id % 4 < 2 THEN 'current' ELSE 'unknown' END AS temporal_intent,
  CASE WHEN event_id % 3 = 0 THEN 'official_primary' ELSE 'unknown' END AS authority, CASE event_id % 5 WHEN 0 THEN 'fresh' WHEN 1 THEN 'aged' ELSE 'unknown' END AS freshness_state, CASE WHEN event_id % 3 = 0 THEN 'current' ELSE 'unknown' END AS applicability FROM events""")  # fmt: skip


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    decision = F.get(F.array(*map(F.lit, ("answer", "abstain", "refuse", "qualify"))), (F.col("turn") % 4).cast("int"))
    run = answers.workflow(guards.gateway(F.col("text")), decision, F.concat(F.lit("BY_"), F.upper(decision)))
    return table(spark, folder, "conversations").select("conv_id", "turn", run.alias("r")).select("conv_id", "turn", "r.final_state", "r.decision", "r.reason", F.array_join("r.states", ">").alias("states"))


ADD("answer_workflows", _runs, f"""WITH g AS (SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(regexp_replace(text, '\\s', ' ', 'g')) = '' THEN 'EMPTY_INPUT' WHEN length(text) > {guards.MOST_CHARACTERS} THEN 'REQUEST_LENGTH_EXCEEDED' WHEN regexp_matches(trim(regexp_replace(text, '{guards.CONTROL}', '', 'g')), '(?i){_quoted(guards.any_of(guards.GATEWAY))}') THEN 'PROMPT_INJECTION_DETECTED' ELSE 'OK' END AS gate,
  (['answer', 'abstain', 'refuse', 'qualify'])[turn % 4 + 1] AS decision FROM conversations), f AS (SELECT *, CASE WHEN gate <> 'OK' THEN 'refused' WHEN decision = 'abstain' THEN 'abstained' WHEN decision = 'refuse' THEN 'refused' ELSE 'completed' END AS final_state FROM g)
SELECT conv_id, turn, final_state, CASE WHEN gate <> 'OK' THEN 'refuse' ELSE decision END AS decision, CASE WHEN gate <> 'OK' THEN gate ELSE 'BY_' || upper(decision) END AS reason,
  CASE WHEN gate <> 'OK' THEN 'refused' WHEN decision IN ('abstain', 'refuse') THEN 'security_checked>classified>evidence_evaluated>' || final_state ELSE 'security_checked>classified>evidence_evaluated>generation_allowed>completed' END AS states FROM f""")  # fmt: skip


def _contracts(spark: SparkSession, folder: str) -> DataFrame:
    checks = [(F.col("o_totalprice") > 1000, "price too low"), (F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus") != "P"), "pending")]
    return table(spark, folder, "orders").select("o_orderkey", answers.violated(checks, "intake", F.col("o_orderkey") % 17 == 0).alias("violation"))


ADD("phase_contracts", _contracts, "SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'Phase intake killed by emergency switch.' WHEN NOT o_totalprice > 1000 THEN 'price too low' WHEN o_orderkey % 13 = 0 OR o_orderstatus = 'P' THEN 'pending' END AS violation FROM orders")


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    own = lambda k, value: F.when(F.col("l_partkey") % k != 0, value)
    value = F.struct(own(3, F.concat(F.lit("j"), "l_suppkey")).alias("job"), own(4, F.concat(F.lit("u"), "l_partkey")).alias("url"), own(5, F.col("l_partkey")).alias("document"), own(6, F.col("l_linenumber").cast("long")).alias("generation"), (F.col("l_linenumber") % 2 == 0).alias("success"), own(7, F.lit("r")).alias("rag_id"))
    context = F.struct(F.lit("batch").alias("job"), F.when(F.col("l_orderkey") % 3 == 0, "base").alias("url"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey")).alias("document"), F.lit(1).cast("long").alias("generation"))
    kind = F.when(F.col("l_returnflag") == "R", "failed").otherwise("success")
    routed = answers.routed(kind, value, context)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", routed.alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "r.*")


ADD("chunk_results_routed", _routed, """WITH v AS (SELECT *, l_returnflag <> 'R' AS ok FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, l_partkey, ok, coalesce(CASE WHEN ok AND l_partkey % 3 <> 0 THEN 'j' || l_suppkey END, 'batch') AS job, coalesce(CASE WHEN ok AND l_partkey % 4 <> 0 THEN 'u' || l_partkey END, CASE WHEN l_orderkey % 3 = 0 THEN 'base' END) AS url,
  coalesce(CASE WHEN ok AND l_partkey % 5 <> 0 THEN l_partkey END, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey END) AS document, coalesce(CASE WHEN ok AND l_partkey % 6 <> 0 THEN l_linenumber END, 1)::BIGINT AS generation FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ok AND l_linenumber % 2 = 0 AND l_partkey % 7 <> 0 AND url IS NOT NULL THEN 'clear' WHEN url IS NOT NULL AND document IS NOT NULL THEN 'failure' ELSE 'nothing' END AS action, job, url, document, generation FROM r""")  # fmt: skip


def _named(spark: SparkSession, folder: str) -> DataFrame:
    explicit = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  -- Doc. "), F.col("text"))).when(F.col("doc_id") % 3 == 1, "").otherwise(F.lit("..--"))
    explicit = F.when(F.col("doc_id") % 6 == 2, F.lit(None).cast("string")).otherwise(explicit)
    return table(spark, folder, "documents").select("doc_id", documents.document_id(F.concat_ws("/", "source", "doc_id"), explicit).alias("id"), documents.sanitized(F.col("text"), 200).alias("title"))


_flat = "trim(regexp_replace(regexp_replace(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g'))"
ADD("document_names", _named, f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN n WHEN 3 THEN n WHEN 5 THEN NULL ELSE substr(sha256(source || '/' || doc_id), 1, 24) END AS id, title FROM (
  SELECT doc_id, source, left({_flat.replace("x,", "text,", 1)}, 200) AS title, left(regexp_replace(regexp_replace(lower(left({_flat.replace("x,", "'  -- Doc. ' || text,", 1)}, 160)), '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 96) AS n FROM documents)""")  # fmt: skip
ADD("comparison_urls", lambda s, f: table(s, f, "pages").select("page_id", documents.comparison_url(F.col("url")).alias("key")), """SELECT page_id, CASE WHEN NOT regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^/?#:@]+(:[0-9]+)?([/?#]|$)') THEN ''
  ELSE regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1') || CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '^[^?#]*(\\?[^#]+)', 1) END AS key FROM pages""")  # fmt: skip
ADD("markdown_normalized", lambda s, f: table(s, f, "documents").select("doc_id", F.md5(documents.normalized_markdown(F.col("text"))).alias("digest")), """WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM l),
t AS (SELECT doc_id, pos, regexp_replace(line, '\\s+$', '') AS line FROM e), s AS (SELECT *, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM t WHERE line <> ''),
k AS (SELECT doc_id, pos, line FROM t WHERE line = '' UNION ALL SELECT doc_id, pos, line FROM s WHERE before IS DISTINCT FROM trim(line) OR length(trim(line)) > 120)
SELECT doc_id, md5(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM k GROUP BY doc_id""")  # fmt: skip
_sql = lambda pattern: pattern.replace("'", "''")
ADD("text_qualities", lambda s, f: table(s, f, "documents").select("doc_id", documents.text_quality(F.col("text")).alias("q")).select("doc_id", "q.garbage", F.round("q.score", 6).alias("score"), F.array_join("q.reasons", ",").alias("reasons"), "q.words", "q.alphabetic", "q.lines", F.round("q.letter_share", 6).alias("letter_share")), f"""WITH s AS (
  SELECT doc_id, regexp_extract_all(text, '{_sql(WORD)}') AS w, list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s', ' ', 'g')) <> '' AND NOT regexp_matches(x, '{_sql(MARKER)}') AND NOT regexp_matches(x, '{_sql(RULE)}')) AS l, regexp_replace(text, '\\s', '', 'g') AS c FROM documents
), c AS (
  SELECT doc_id, len(w) AS words, list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}')) AS a, len(l) AS lines, len(list_filter(l, lambda x: len(string_split(x, '|')) > 2)) AS tables, length(c) AS n, length(regexp_replace(c, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters, length(regexp_replace(c, '[^' || chr(65533) || '\\p{{Co}}\\p{{Cc}}]', '', 'g')) AS odd FROM s
), k AS (
  SELECT *, len(a) AS alphabetic, len(list_distinct(list_transform(a, lambda x: lower(x)))) AS distinct_, CASE WHEN lines > 0 THEN tables / lines ELSE 0 END AS table_share, CASE WHEN n > 0 THEN letters / n ELSE 0 END AS letter_share, CASE WHEN n > 0 THEN odd / n ELSE 0 END AS odd_share FROM c
), r AS (
  SELECT *, CASE WHEN n = 0 THEN ['empty_after_cleaning'] ELSE list_filter([CASE WHEN words < 50 THEN 'too_few_words' END, CASE WHEN alphabetic < 10 THEN 'too_few_alphabetic_words' END, CASE WHEN table_share > 0.5 AND alphabetic < greatest(words // 3, 8) THEN 'mostly_numeric_or_symbolic_table' END,
    CASE WHEN letter_share < 0.22 AND alphabetic < 50 THEN 'symbol_heavy_output' END, CASE WHEN odd_share > 0.02 THEN 'many_invalid_or_unmapped_glyphs' END, CASE WHEN alphabetic >= 30 AND distinct_ / alphabetic < 0.06 THEN 'extremely_repetitive_text' END], lambda x: x IS NOT NULL) END AS reasons FROM k
), z AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(0, 1 - (CASE WHEN list_contains(reasons, 'too_few_words') THEN 0.6e0 ELSE 0 END + CASE WHEN list_contains(reasons, 'too_few_alphabetic_words') THEN 0.45e0 ELSE 0 END + CASE WHEN list_contains(reasons, 'mostly_numeric_or_symbolic_table') THEN 0.55e0 ELSE 0 END
    + CASE WHEN list_contains(reasons, 'symbol_heavy_output') THEN 0.4e0 ELSE 0 END + CASE WHEN odd_share > 0.02 THEN least(0.6e0, odd_share * 10) ELSE 0 END + CASE WHEN list_contains(reasons, 'extremely_repetitive_text') THEN 0.35e0 ELSE 0 END)) END AS score FROM r
) SELECT doc_id, n = 0 OR (words < 50 AND alphabetic < 25) OR score < 0.45 AS garbage, round(score, 6) AS score, array_to_string(reasons, ',') AS reasons, words, alphabetic, lines, round(letter_share, 6) AS letter_share FROM z""")  # fmt: skip
