"""Crawl candidates, and the links and images that pages keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import candidates, markup, urls
from tessella.operators import evaluation
from tessella.sources.tables import table

from .pairs import Family

FAMILY = Family()
# What is put behind a page's address, by the number of the page: actions in several layers of escapes, and what is none.
TAILS = [
    "", "/delete", "/%64elete", "/%2564elete/x", "/%252564elete", "/%2525252564elete", "/%252525252525252564elete", "?action=delete", "?do=%2564elete&x=1", "/deleted-records-policy",
    "/style.css", "/robots.txt", "?logout=1", "?action=DELETE", "/private/a.html", "/scan.zip;v=2", "/100%/a+b", "?op=a%2Breset", "?logout", "/A-Submit-b",
]
SCOPE = {"origins": ("http://the.example.com",), "suffixes": ("example.com", "example.net")}
SKIP, EXCLUDE = (".zip", ".exe"), ("*/private/*",)
HOST, MOST_LINKS, MOST_IMAGES = "example.com", 4, 3
WEIGHTY = ("admission", "fee", "merit", "notice", "th")


def _addresses(spark: SparkSession, folder: str) -> DataFrame:
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("page_id") % len(TAILS)).cast("int"))
    return table(spark, folder, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[^?#]*", 0), tail).alias("url"))


_tails = "[" + ", ".join(f"'{t}'" for t in TAILS) + "]"
_names = "[" + ", ".join(f"'{w}'" for w in urls.MUTATIONS) + "]"
_keys = "[" + ", ".join(f"'{w}'" for w in urls.ACTION_KEYS) + "]"


def _unescaped(x: str) -> str:
    """Five rounds of decoding; null if a sixth round, or the fifth, still changes the text."""
    once = x
    for _ in range(urls.LAYERS - 1):
        once = f"url_decode({once})"
    return f"CASE WHEN url_decode({once}) = {once} THEN {once} END"


_asks = lambda x: f"list_has_any(string_split_regex({x}, '[^a-z0-9]+'), {_names})"
ADDRESSES = f"""a AS (SELECT page_id, regexp_extract(url, '^[^?#]*') || ({_tails})[page_id % {len(TAILS)} + 1] AS url FROM pages),
parts AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segments, list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda s: s <> '') AS pairs FROM a),
opened AS (SELECT page_id, url, list_transform(segments, lambda s: {_unescaped('s')}) AS segments, list_transform(pairs, lambda p: {{'k': lower(url_decode(replace(string_split(p, '=')[1], '+', ' '))), 'v': url_decode(replace(CASE WHEN contains(p, '=') THEN p[instr(p, '=') + 1:] ELSE '' END, '+', ' '))}}) AS pairs FROM parts),
deep AS (SELECT page_id, url, segments, list_transform(pairs, lambda p: {{'k': {_unescaped('p.k')}, 'v': {_unescaped('p.v')}}}) AS pairs FROM opened),
m AS (SELECT page_id, url, len(list_filter(segments, lambda s: coalesce({_asks('lower(s)')}, true))) > 0 OR len(list_filter(pairs, lambda p: coalesce((list_contains({_names}, p.k) AND p.v <> '') OR (list_contains({_keys}, p.k) AND {_asks('p.v')}), true))) > 0 AS changes FROM deep)"""
FAMILY.add("url_mutations", lambda s, f: _addresses(s, f).select("page_id", "url", urls.changes_something(F.col("url")).alias("changes")), f"WITH {ADDRESSES} SELECT page_id, url, changes FROM m")
_low = "regexp_replace(lower(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';')[1]), '/+$', '')"
_ends = " OR ".join(f"ends_with(low, '{e}')" for e in (*SKIP, *urls.ASSETS))
FAMILY.add(
    "crawl_candidates",
    lambda s, f: _addresses(s, f).select("page_id", urls.crawl_candidate(F.col("url"), SCOPE["origins"], SCOPE["suffixes"], SKIP, exclude=EXCLUDE).alias("candidate")),
    f"""WITH {ADDRESSES}, c AS (SELECT *, {_low} AS low FROM m)
SELECT page_id, (regexp_matches(url, '^http://the[.]example[.]com(:80)?([/?#]|$)') OR regexp_matches(url, '^https://([^:/?#]+[.])?example[.](com|net)(:443)?([/?#]|$)')) AND NOT ({_ends})
  AND NOT list_contains({list(urls.NOT_CRAWLED)}, regexp_extract(low, '([^/]*)$', 1)) AND NOT regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/private/') AND NOT changes AS candidate FROM c""",
)


def _links(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", candidates.links(F.col("html"), F.col("url")).alias("links"))
    scored = F.transform("links", lambda x: F.struct(urls.resource_score(x["url"], x["label"], WEIGHTY, HOST).alias("score"), x["at"].alias("at"), x["url"].alias("url")))
    kept = candidates.kept_links(scored, MOST_LINKS, F.col("page_id") % 2 == 0)
    return pages.select("page_id", F.posexplode(kept).alias("place", "l")).select("page_id", (F.col("place") + 1).alias("place"), "l.url", "l.score")


_own = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
_hits = " + ".join(f"contains(low, '{w}')::INT" for w in WEIGHTY)
_kinds = "[" + ", ".join(f"'{n}'" for names in urls.KINDS.values() for n in names) + "]"
_files = "[" + ", ".join(f"'{n}'" for kind in ("pdf", "document", "spreadsheet", "calendar") for n in urls.KINDS[kind]) + "]"
LINKS = f"""a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages),
e AS (SELECT page_id, {_own} AS host, unnest(l) AS tag, generate_subscripts(l, 1) AS pos FROM a),
t AS (SELECT page_id, pos, host || regexp_extract(tag, 'href="([^"]*)"', 1) AS url, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM e),
o AS (SELECT page_id, url, arg_min(label, pos) AS label, min(pos) AS pos FROM t GROUP BY page_id, url),
k AS (SELECT *, lower(label || ' ' || url) AS low, lower(regexp_extract(url, '^[^?#]*[.]([A-Za-z0-9]+)([?#]|$)', 1)) AS x FROM o),
s AS (SELECT page_id, url, label, pos, CASE WHEN list_contains({_kinds}, x) THEN 120 ELSE 0 END + CASE WHEN list_contains({_files}, x) THEN 60 ELSE 0 END + 18 * ({_hits}) + CASE WHEN regexp_matches(label, '\\b[0-9]{{1,2}}[-/ ][A-Za-z0-9]{{1,9}}[-/ ][0-9]{{2,4}}\\b') THEN 35 ELSE 0 END
  + CASE WHEN regexp_matches(lower(url), '^https?://[^/:?#]*example[.]com([/:?#]|$)') THEN 15 ELSE 0 END AS score FROM k)"""
FAMILY.add(
    "page_links_kept",
    _links,
    f"""WITH {LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS came, row_number() OVER (PARTITION BY page_id ORDER BY score DESC) AS by_score, count(*) OVER (PARTITION BY page_id) AS n FROM s),
l AS (SELECT *, max(score) FILTER (by_score = least(n, {MOST_LINKS})) OVER (PARTITION BY page_id) AS least FROM r),
q AS (SELECT *, count(*) FILTER (score >= least) OVER (PARTITION BY page_id ORDER BY pos) AS reached, count(*) FILTER (score > least) OVER (PARTITION BY page_id) AS above FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY page_id, score = least AND reached <= {MOST_LINKS} ORDER BY pos DESC) AS back FROM q),
kept AS (SELECT * FROM u WHERE CASE WHEN page_id % 2 = 0 AND n > {MOST_LINKS} THEN score > least OR (score = least AND reached <= {MOST_LINKS} AND back <= {MOST_LINKS} - above) ELSE came <= {MOST_LINKS} END)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place, url, score FROM kept""",
)


def _pictured(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose links are images, with sizes by their number and the link's text as label."""
    size = (F.col("page_id") % 7 * 100).cast("string")
    tag = F.concat(F.lit('<img src="$1.png?w='), size, F.lit('" alt="$2" width="'), size, F.lit('" class="fig"> $2 <br>'))
    return table(spark, folder, "pages").select("page_id", "url", F.regexp_replace("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), tag).alias("html"))


def _images(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates.best_images(F.col("html"), F.col("url"), F.col("page_id") % 2 == 0, MOST_IMAGES)
    return _pictured(spark, folder).select("page_id", F.posexplode(found).alias("place", "i")).select("page_id", (F.col("place") + 1).alias("place"), "i.url", "i.label", F.round("i.score", 6).alias("score"))


def _words(text: str, words: tuple[str, ...], join: str = " + ") -> str:
    return "(" + join.join(f"contains({text}, '{w}'){'::INT' if join == ' + ' else ''}" for w in words) + ")"


_plain = "[" + ", ".join(f"'{w}'" for w in candidates.PLAIN_LABELS) + "]"
IMAGES = f"""a AS (SELECT page_id, {_own} AS host, page_id % 7 * 100 AS size, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages),
e AS (SELECT page_id, host, size, unnest(l) AS tag, generate_subscripts(l, 1) AS pos FROM a),
t AS (SELECT page_id, pos, size, host || regexp_extract(tag, 'href="([^"]*)"', 1) || '.png?w=' || size AS url, trim(regexp_replace(regexp_extract(tag, '>([^<]*)<', 1), '\\s+', ' ', 'g')) AS text FROM e),
n AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/?#]*)[.]png[?]', 1), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM t),
b AS (SELECT *, CASE WHEN text <> '' AND NOT list_contains({_plain}, lower(text)) THEN text WHEN name <> '' AND NOT list_contains({_plain}, lower(name)) THEN name WHEN text <> '' THEN text WHEN name <> '' THEN name ELSE 'Page image' END AS label FROM n),
w AS (SELECT *, lower(path) AS p, lower(label) AS lab, lower(path) || ' ' || lower(label) AS direct, lower(path) || ' ' || lower(label) || ' ' || lower(text) AS everything FROM b),
g AS (SELECT *, {_words('direct', candidates.STRONG, ' OR ')} OR regexp_matches(direct, '(^|[\\s_/-])ad([\\s_.?/-]|$)') AS strong FROM w),
v AS (SELECT *, CASE WHEN ((list_contains({_plain}, lab) OR {_words('lab', candidates.PLAIN_WORDS, ' OR ')}) AND {_words('p', candidates.DECORATIVE, ' OR ')} OR {_words('direct', candidates.PERSONS, ' OR ')} OR {_words('direct', candidates.FILLERS, ' OR ')}) AND NOT strong THEN -100e0
  ELSE 4e0 * {_words('everything', candidates.HIGH)} - 5 * {_words('everything', candidates.LOW)} + CASE WHEN strong THEN 6 ELSE 0 END + CASE WHEN page_id % 2 = 0 THEN 5 * {_words('everything', candidates.KNOWN_SITE)} ELSE 0 END
    + CASE WHEN size >= 500 THEN 1.5 WHEN size >= 250 THEN 0.75 WHEN size > 0 AND size < 80 THEN -4 ELSE 0 END + 1 + least(2e0, length(text) / 350e0) END AS score FROM g),
i AS (SELECT page_id, path, arg_min({{'url': url, 'label': label, 'score': score, 'pos': pos}}, {{'s': -score, 'pos': pos}}) AS x FROM v GROUP BY page_id, path),
r AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY x.score DESC, lower(x.url), x.pos) AS place, x.url AS url, x.label AS label, round(x.score, 6) AS score FROM i WHERE x.score > 0)"""
FAMILY.add("page_images", _images, f"WITH {IMAGES} SELECT * FROM r WHERE place <= {MOST_IMAGES}")

_roots = ("https://ththre.example.com/en", "http://the.example.com")
FAMILY.sql("url_tiers_bare", f"SELECT page_id, {urls.tier('url', _roots, bare=True)} AS tier FROM {{pages}}")


def _hidden_emails(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses as pairs of hex digits behind their key, each combined with it."""
    key = (F.col("doc_id") % 255 + 1).cast("int")
    own = F.concat(F.lit("user"), F.col("doc_id").cast("string"), F.lit("@example.com"))
    pair = lambda n: F.lower(F.lpad(F.hex(n), 2, "0"))
    code = F.array_join(F.concat(F.array(pair(key)), F.transform(F.filter(F.split(own, ""), lambda c: c != ""), lambda c: pair(F.ascii(c).bitwiseXOR(key)))), "")
    return table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "no code").otherwise(code).alias("code"))


FAMILY.add("emails_decoded", lambda s, f: _hidden_emails(s, f).select("doc_id", markup.decoded_email(F.col("code")).alias("email")), "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'no code' ELSE 'user' || doc_id || '@example.com' END AS email FROM documents")
_phrases = ["the", "and  the", "THE NEW", "of"]
FAMILY.add(
    "phrases_present",
    lambda s, f: table(s, f, "documents").select("doc_id", F.array_join(evaluation.required_present(F.col("text"), F.array(*map(F.lit, _phrases))), "|").alias("required"), F.array_join(evaluation.forbidden_present(F.col("text"), F.array(*map(F.lit, _phrases))), "|").alias("forbidden")),
    f"""WITH d AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), chr(160), ' '), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, array_to_string(list_filter({_phrases}, lambda p: contains(t, trim(regexp_replace(lower(p), '\\s+', ' ', 'g')))), '|') AS required, array_to_string(list_filter({_phrases}, lambda p: contains(t, trim(regexp_replace(lower(p), '\\s+', ' ', 'g')))), '|') AS forbidden FROM d""",
)
