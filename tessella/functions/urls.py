"""URL tests and forms as SQL expressions; hosts that a site treats specially are parameters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of a URL that put it in the high or in the medium tier.
HIGH_TIER = ("admission", "academic", "merit", "fee", "schedule", "seat", "result", "exam", "deadline", "notice", "scholarship", "prospectus")
MEDIUM_TIER = ("department", "faculty", "program")
# Crawl scores of a root, of topics, and the most for a short path; words of the second topic group.
ROOT_SCORE, FIRST_SCORE, SECOND_SCORE, MEDIUM_SCORE, SHORT_SCORE = 200, 150, 100, 75, 20
FIRST_WORDS, SECOND_WORDS = ("admission", "academic"), ("fee", "merit", "prospectus", "deadline")
# Kinds of files by their extensions.
KINDS = {
    "pdf": ("pdf",),
    "document": ("doc", "docx", "odt", "rtf", "txt", "md", "markdown"),
    "calendar": ("ics",),
    "spreadsheet": ("xls", "xlsx", "ods"),
    "data": ("csv", "json", "xml", "yaml", "yml"),
    "presentation": ("ppt", "pptx", "odp"),
    "ebook": ("epub",),
    "archive": ("zip", "rar", "7z", "tar", "gz", "tgz", "bz2", "xz"),
    "video": ("mp4", "webm", "avi", "mov", "mkv", "m4v"),
    "audio": ("mp3",),
}
PDF_SCHEME = "pdf://"


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def tier(url: str, roots: tuple[str, ...], bare: bool = False) -> str:
    """Freshness tier of a URL; bare: the roots match with and without a final slash, else only with it."""
    low = f"lower({url})"
    own = f"rtrim({low}, '/')" if bare else low
    names = ", ".join(f"'{r.rstrip('/')}'" if bare else f"'{r.rstrip('/')}/'" for r in roots)
    return f"CASE WHEN {own} IN ({names}) OR {_any(low, HIGH_TIER)} THEN 'high' WHEN {_any(low, MEDIUM_TIER)} THEN 'medium' ELSE 'low' END"


def priority(url: str, stripped: str, segments: str, roots: tuple[str, ...]) -> str:
    """Crawl score of a URL: roots, topics, and fewer path segments first."""
    low = f"lower({url})"
    names = ", ".join(f"'{r.rstrip('/')}'" for r in roots)
    return (
        f"CASE WHEN {stripped} IN ({names}) THEN {ROOT_SCORE} ELSE 0 END + CASE WHEN {_any(low, FIRST_WORDS)} THEN {FIRST_SCORE} ELSE 0 END"
        f" + CASE WHEN {_any(low, SECOND_WORDS)} THEN {SECOND_SCORE} ELSE 0 END + CASE WHEN {_any(low, MEDIUM_TIER)} THEN {MEDIUM_SCORE} ELSE 0 END + greatest(0, {SHORT_SCORE} - {segments})"
    )


def is_pdf(url: str) -> bool:
    """Whether a URL stands for a PDF that was taken in as a file."""
    return url.startswith(PDF_SCHEME) or re.match(r"https://[^/]*[.]local/pdf/", url) is not None


def origin(url: Column) -> Column:
    """Scheme, host and port of a web address in lower case, the scheme's own port left out; null for others and for ones with a user."""
    low = F.lower(F.trim(url))
    part = lambda k: F.regexp_extract(low, r"^(https?)://(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+)(?::([0-9]+))?(?:[/?#]|$)", k)
    scheme, host, port = part(1), F.regexp_replace(part(2), "[.]$", ""), part(3)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port))))


def within(url: Column, origins: tuple[str, ...], suffixes: tuple[str, ...]) -> Column:
    """Whether a URL has one of the origins, or is https on one of the hosts or below it."""
    own = origin(url)
    host = F.regexp_extract(own, r"^https://([^:/]+)", 1)
    below = [(host == s) | F.endswith(host, F.lit(f".{s}")) for s in suffixes]
    return F.coalesce(own.isin(*origins) | reduce(lambda a, b: a | b, below, F.lit(False)), F.lit(False))


def resource_kind(url: Column) -> Column:
    """Kind of a linked file by the extension of its path, 'page' for others."""
    extension = F.lower(F.regexp_extract(F.regexp_extract(url, "^([^?#]*)", 1), r"[.]([A-Za-z0-9]+)$", 1))
    out = F.lit("page")
    for kind, names in KINDS.items():
        out = F.when(extension.isin(*names), kind).otherwise(out)
    return out


def resource_score(url: Column, label: Column, words: tuple[str, ...], host: str) -> Column:
    """How much a link is worth: files first, then words of weight, dates in the label and the own host."""
    kind, everything = resource_kind(url), F.lower(F.concat_ws(" ", label, url))
    hits = reduce(lambda a, b: a + b, [F.contains(everything, F.lit(w)).cast("int") for w in words])
    dated = label.rlike(r"\b[0-9]{1,2}[-/ ][A-Za-z0-9]{1,9}[-/ ][0-9]{2,4}\b")
    own = F.regexp_extract(F.lower(url), "^https?://([^/:?#]+)", 1)
    return F.when(kind != "page", 120).otherwise(0) + F.when(kind.isin("pdf", "document", "spreadsheet", "calendar"), 60).otherwise(0) + hits * 18 + F.when(dated, 35).otherwise(0) + F.when(F.endswith(own, F.lit(host)), 15).otherwise(0)


def ranked(links: DataFrame, page: str, most: int = 150) -> DataFrame:
    """Of links (page, url, label, at, score) one for each lower-case label and URL, by score and place, at most so many a page: with place from 1."""
    first = Window.partitionBy(page, F.lower("label"), "url").orderBy("at")
    one = links.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("score"), "at"))).where(F.col("place") <= most)


# Actions that change something, query keys whose values are actions, files of pages' makeup, and addresses that other parts of a crawler read.
MUTATIONS = ("logout", "logoff", "signout", "delete", "remove", "destroy", "submit", "unsubscribe", "approve", "reject", "activate", "deactivate", "reset", "purge", "terminate")
ACTION_KEYS = ("action", "do", "cmd", "command", "operation", "op", "task", "act")
ASSETS = (".css", ".js", ".mjs", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".ico", ".map")
NOT_CRAWLED = ("robots", "robots.txt", "sitemap", "sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap.txt")
LAYERS = 5


def percent_decoded(text: Column) -> Column:
    """``text`` with its percent escapes decoded once; what is no escape, and a plus sign, stays."""
    whole = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(F.contains(text, F.lit("%")), F.try_url_decode(whole)).otherwise(text)


def decoded(text: Column, layers: int = LAYERS) -> Column:
    """``text`` decoded until nothing changes; null where so many rounds, the one that finds no change included, are not enough."""
    start = F.struct(text.alias("text"), F.lit(False).alias("still"))

    def once(state: Column, _: Column) -> Column:
        after = F.when(state["still"], state["text"]).otherwise(percent_decoded(state["text"]))
        return F.struct(after.alias("text"), (state["still"] | (after == state["text"])).alias("still"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(layers)), start, once, lambda s: F.when(s["still"], s["text"]))


def _has_action(text: Column) -> Column:
    return F.arrays_overlap(F.split(text, "[^a-z0-9]+"), F.array(*map(F.lit, MUTATIONS)))


def changes_something(url: Column) -> Column:
    """Whether a URL asks for a change, or is encoded too deeply to tell.

    A whole word of a path segment, the name of a query parameter with a
    value, or a word of an action's value may ask for it, however often it is
    encoded; words count, so deleted-records is none.  Null for null.
    """
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    in_path = F.exists(segments, lambda s: F.coalesce(_has_action(F.lower(decoded(s))), F.lit(True)))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    plain = lambda t: percent_decoded(F.replace(t, F.lit("+"), F.lit(" ")))

    def asks(pair: Column) -> Column:
        key = decoded(F.lower(plain(F.substring_index(pair, "=", 1))))
        value = decoded(plain(F.when(F.contains(pair, F.lit("=")), F.substr(pair, F.instr(pair, "=") + 1)).otherwise("")))
        named = key.isin(*MUTATIONS) & (value != "")
        return F.coalesce(named | (key.isin(*ACTION_KEYS) & _has_action(value)), F.lit(True))

    in_query = F.exists(F.filter(F.split(query, "&"), lambda s: s != ""), asks)
    return F.when(url.isNotNull(), in_path | in_query)


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c, end = pattern[i], pattern.find("]", i + 2)
        if c == "[" and end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[^{inside[1:]}]" if inside[0] == "!" else f"[{inside}]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s)^{out}$"


def _meets(url: Column, path: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [(url if p.startswith(("http://", "https://")) else path).rlike(glob(p)) for p in patterns], F.lit(False))


def crawl_candidate(url: Column, origins: tuple[str, ...], suffixes: tuple[str, ...], skip: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a URL may enter the crawl: within scope, no skipped or makeup file, nothing that other parts read, by the patterns, and no change."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    low = F.regexp_replace(F.lower(F.substring_index(path, ";", 1)), "/+$", "")
    ends = reduce(lambda a, b: a | b, [F.endswith(low, F.lit(e)) for e in (*skip, *ASSETS)])
    by_pattern = ~_meets(url, path, exclude) & (_meets(url, path, include) if include else F.lit(True))
    allowed = within(url, origins, suffixes) & ~ends & ~F.substring_index(low, "/", -1).isin(*NOT_CRAWLED) & by_pattern
    return F.coalesce(allowed & ~changes_something(url), F.lit(False))
