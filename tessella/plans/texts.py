"""Text, URL, chunk-key and HTML expressions over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import chunking, urls
from tessella.sources.tables import table

from .pairs import Family

FAMILY = Family()
ROOTS = ("http://the.example.com", "https://and.example.com")


def _both(name: str, text: str, *, g: bool = True) -> None:
    """One statement for both engines, but for DuckDB's flag to replace every match and its regexp_matches."""
    duck = text.replace("regexp_like(", "regexp_matches(").replace("sha2(", "sha256(").replace(", 256)", ")").replace("array_join(", "array_to_string(")
    if g:
        duck = duck.replace("/*g*/", ", 'g'")
    FAMILY.sql(name, text, duck)


_both("url_tiers", f"SELECT page_id, {urls.tier('url', ROOTS)} AS tier FROM {{pages}}")
_strip, _path = "regexp_replace(lower(url), '/+$', '')", "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_segments = f"length(regexp_replace(regexp_replace({_path}, '/+', '/'/*g*/), '[^/]', ''/*g*/)) - CASE WHEN {_path} LIKE '%/' THEN 1 ELSE 0 END"
_both("url_priority", f"SELECT page_id, {urls.priority('url', _strip, f'({_segments})', ROOTS)} AS score FROM {{pages}}")
_both("url_canonical", "SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') AS canonical FROM {pages}")
_both("url_normalized", "SELECT page_id, concat(lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)), regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1), '/+$', '')) AS normalized FROM {pages}")
_both("url_host_official", "SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]*)', 1) AS host, regexp_like(lower(url), '^https?://([^/:?#]*[.])?example[.]com([/:?#]|$)') AS official FROM {pages}")
_both("url_family", "SELECT CASE WHEN regexp_like(lower(url), '[.]pdf([?#]|$)') THEN 'pdf' WHEN regexp_like(lower(url), '[.]aspx([?#]|$)') THEN 'aspx' WHEN regexp_like(lower(url), '[.]asp([?#]|$)') THEN 'asp' ELSE 'other' END AS family, count(*) AS n FROM {pages} GROUP BY 1")
_both("url_query_keys", "SELECT page_id, array_join(regexp_extract_all(url, '[?&]([^=&#]+)=', 1), '|') AS keys FROM {pages}")
_both("url_dedupe_first", "WITH u AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base FROM {pages}) SELECT base, min(page_id) AS page_id FROM u GROUP BY base")
_MADE = "[Home](/)\n* [Facebook](https://x)\n[top](#a)\n| |\nText  \n\n\n\n"


def _normalized() -> str:
    out = "concat('" + _MADE.replace("\n", "' || chr(10) || '") + "', text)"
    for pattern, instead in chunking.RULES:
        out = f"regexp_replace({out}, '{pattern}', " + (" || ".join(["chr(10)"] * len(instead)) or "''") + ", 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


FAMILY.add("normalize_content", lambda s, f: table(s, f, "documents").select("doc_id", F.sha2(chunking.normalized(F.concat(F.lit(_MADE), "text")), 256).alias("digest")), f"SELECT doc_id, sha256({_normalized()}) AS digest FROM documents")
FAMILY.sql("quality_chunk", "SELECT doc_id, size(filter(split(text, '\\\\s+'), w -> length(w) > 1)) >= 5 AS usable FROM {documents}", "SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 1)) >= 5 AS usable FROM documents")
_both("chunk_keys", "SELECT doc_id, sha2(concat('1|doc://', CAST(doc_id AS STRING), '|', source, '>', lang, '|', CAST(doc_id % 3 AS STRING)), 256) AS chunk_key, sha2(concat(sha2(concat('1|doc://', CAST(doc_id AS STRING), '|', source, '>', lang, '|', CAST(doc_id % 3 AS STRING)), 256), '|', CAST(doc_id AS STRING), '|1'), 256) AS version_key FROM {documents}")
_both("indexing_fingerprint", "SELECT sha2('chunkingVersion=1|parentChunkSize=3000|parentChunkOverlap=300|childChunkSize=800|childChunkOverlap=100|contextPrefixVersion=1|embeddingModel=stub|embeddingDimension=768', 256) AS fingerprint")
_both("heading_ordinals", "SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS ordinal FROM {documents}")
_both("context_prefix", "SELECT page_id, concat('Document Title: ', CAST(page_id AS STRING), chr(10), CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) NOT IN ('', '/') THEN concat('URL Path: ', regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), chr(10)) ELSE '' END) AS prefix FROM {pages}")
_both("excerpts", "SELECT doc_id, substring(text, 1, 300) AS excerpt, substring(text, 1, 20) AS preview, length(text) > 2000 AS cut FROM {documents}")
_both("escape_xml", "SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;') AS escaped FROM {conversations}")
_both("exact_duplicates", "SELECT sha2(text, 256) AS digest, count(*) AS n, min(doc_id) AS keeper FROM {documents} GROUP BY 1 HAVING count(*) > 1")
_both("crawl_stats", "SELECT source, sum(CAST(ceil(length(text) / 3000e0) AS BIGINT)) AS chunks, sum(CAST(ceil(length(text) / 4e0) AS BIGINT)) AS tokens, sum(CAST(strlen(text) AS BIGINT)) AS bytes FROM {documents} GROUP BY source")
FAMILY.queries.pop("crawl_stats")
FAMILY.sql("crawl_stats", "SELECT source, sum(CAST(ceil(length(text) / 3000e0) AS BIGINT)) AS chunks, sum(CAST(ceil(length(text) / 4e0) AS BIGINT)) AS tokens, sum(CAST(octet_length(text) AS BIGINT)) AS bytes FROM {documents} GROUP BY source", FAMILY.oracle["crawl_stats"])
_both("corpus_manifest", "SELECT source, count(*) AS n, count(DISTINCT sha2(text, 256)) AS distinct_n, min(sha2(text, 256)) AS first_digest FROM {documents} GROUP BY source")
_both("html_title", "SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading FROM {pages}")
_both("html_links", "SELECT page_id, array_join(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), ' ') AS links FROM {pages}")
_both("html_link_counts", "WITH l AS (SELECT page_id, explode(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM {pages}) SELECT link, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY link")
FAMILY.oracle["html_link_counts"] = FAMILY.oracle["html_link_counts"].replace("explode(", "unnest(")
_both("html_robots", "SELECT page_id, regexp_like(lower(html), '<meta[^>]+name=.robots[^>]+noindex') AS noindex, regexp_like(lower(html), '<meta[^>]+name=.robots[^>]+nofollow') AS nofollow FROM {pages}")
_both("html_language", "SELECT page_id, regexp_extract(lower(html), '<html[^>]+lang=.([a-z]+)', 1) AS lang, regexp_extract(lower(html), 'charset=.?([a-z0-9-]+)', 1) AS charset FROM {pages}")
_both("html_contacts", "SELECT page_id, array_distinct(regexp_extract_all(lower(html), '[a-z0-9._]+@[a-z0-9.-]+[.][a-z]+', 0)) AS emails FROM {pages}")
FAMILY.oracle["html_contacts"] = "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(html), '[a-z0-9._]+@[a-z0-9.-]+[.][a-z]+'))), ' ') AS emails FROM pages"
FAMILY.sql("html_contacts", "SELECT page_id, array_join(array_sort(array_distinct(regexp_extract_all(lower(html), '[a-z0-9._]+@[a-z0-9.-]+[.][a-z]+', 0))), ' ') AS emails FROM {pages}", FAMILY.oracle["html_contacts"])
_both("html_kind", "SELECT page_id, CASE WHEN starts_with(html, '%PDF') THEN 'pdf' WHEN regexp_like(lower(substring(html, 1, 500)), '<!doctype html|<html') THEN 'html' ELSE 'unsupported' END AS kind, regexp_like(lower(html), 'enable javascript|<div id=.(root|app|__next).></div>') AS shell FROM {pages}")
FAMILY.sql("html_kind", FAMILY.oracle["html_kind"].replace("FROM pages", "FROM {pages}").replace("starts_with", "startswith").replace("regexp_matches", "regexp_like"), FAMILY.oracle["html_kind"])
_both("html_images", "SELECT page_id, array_size(regexp_extract_all(lower(html), '<img[^>]+src=', 0)) AS images, array_size(regexp_extract_all(lower(html), '<script', 0)) AS scripts FROM {pages}")
FAMILY.oracle["html_images"] = "SELECT page_id, len(regexp_extract_all(lower(html), '<img[^>]+src=')) AS images, len(regexp_extract_all(lower(html), '<script')) AS scripts FROM pages"
_both("sitemap_urls", "SELECT count(*) AS n, count(DISTINCT regexp_extract(url, '^https?://([^/]+)', 1)) AS hosts, sum(CASE WHEN url LIKE '%/de/%' THEN 1 ELSE 0 END) AS included FROM {pages}")
_both("word_sets", "SELECT doc_id, size(array_distinct(filter(split(lower(text), '[^a-z0-9@]+'), w -> length(w) > 1))) AS words FROM {documents}")
FAMILY.oracle["word_sets"] = "SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9@]+'), lambda w: length(w) > 1))) AS words FROM documents"
_both("pdf_line_boilerplate", "WITH l AS (SELECT source, doc_id, explode(split(text, '\\n')) AS line FROM {documents}) SELECT source, line, count(DISTINCT doc_id) AS docs FROM l WHERE length(trim(line)) > 0 GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3")
FAMILY.oracle["pdf_line_boilerplate"] = "WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT source, line, count(DISTINCT doc_id) AS docs FROM l WHERE length(trim(line)) > 0 GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3"

FAMILY.add("url_origins", lambda s, f: table(s, f, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"), urls.within(F.col("url"), ("http://the.example.com",), ("example.com",)).alias("inside")),
    """WITH p AS (SELECT page_id, lower(regexp_extract(trim(url), '^([hH][tT][tT][pP][sS]?://[^/?#:@]+(:[0-9]+)?)([/?#]|$)', 1)) AS o FROM pages), q AS (SELECT page_id, CASE WHEN o <> '' THEN regexp_replace(regexp_replace(o, '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1') END AS origin FROM p)
SELECT page_id, origin, coalesce(origin = 'http://the.example.com' OR regexp_matches(origin, '^https://([^:/]+[.])?example[.]com(:[0-9]+)?$'), false) AS inside FROM q""")  # fmt: skip
_WEIGHTY = ("admission", "fee", "merit", "notice")


def _resources(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("at", "url")).withColumn("label", F.regexp_extract("url", "([^/]*)$", 1))
    return urls.ranked(links.withColumn("score", urls.resource_score(F.col("url"), F.col("label"), _WEIGHTY, "example.com")), "page_id").select("page_id", "url", "score", "place", urls.resource_kind(F.col("url")).alias("kind"))


_kinds = " ".join(f"WHEN x IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names in urls.KINDS.items())
FAMILY.add("resource_manifest", _resources, f"""WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages), e AS (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) AS pos FROM p),
k AS (SELECT *, regexp_extract(url, '([^/]*)$', 1) AS label, lower(regexp_extract(url, '^[^?#]*[.]([A-Za-z0-9]+)([?#]|$)', 1)) AS x FROM e), t AS (SELECT *, CASE {_kinds} ELSE 'page' END AS kind, lower(label || ' ' || url) AS low FROM k),
s AS (SELECT *, CASE WHEN kind <> 'page' THEN 120 ELSE 0 END + CASE WHEN kind IN ('pdf', 'document', 'spreadsheet', 'calendar') THEN 60 ELSE 0 END + 18 * ({' + '.join(f"contains(low, '{w}')::INT" for w in _WEIGHTY)}) + CASE WHEN regexp_matches(label, '\\b[0-9]{{1,2}}[-/ ][A-Za-z0-9]{{1,9}}[-/ ][0-9]{{2,4}}\\b') THEN 35 ELSE 0 END + CASE WHEN regexp_matches(lower(url), '^https?://[^/:?#]*example[.]com([/:?#]|$)') THEN 15 ELSE 0 END AS score FROM t),
o AS (SELECT page_id, url, kind, score, min(pos) AS pos FROM s GROUP BY page_id, url, kind, score, lower(label)), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS place FROM o) SELECT page_id, url, score, place, kind FROM r WHERE place <= 150""")
FAMILY.add("chunk_headers", lambda s, f: table(s, f, "documents").select("doc_id", chunking.chunk_header(F.col("lang"), F.concat(F.lit("doc://"), "doc_id"), F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>")), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 86_400_000), F.when(F.col("doc_id") % 5 == 0, "high"), F.lit(None).cast("string"), F.lit("current")).alias("header")),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Section: ' || source || ' > ' || lang || chr(10) ELSE '' END || 'Source: [' || lang || '](doc://' || doc_id || ')' || chr(10) || 'Retrieved: ' || CASE WHEN doc_id % 3 = 0 THEN strftime(make_timestamp(doc_id * 86400000000), '%Y-%m-%d') ELSE 'unavailable' END || chr(10) || 'Freshness tier: ' || CASE WHEN doc_id % 5 = 0 THEN 'high' ELSE 'unknown' END || chr(10) || 'Freshness state: unknown' || chr(10) || 'Applicability: current' AS header FROM documents")
