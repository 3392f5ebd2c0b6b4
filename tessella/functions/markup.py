"""What pages and responses say of addresses and delays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSEEN = r"(?is)<(?:script|style|noscript|template)\b.*?</(?:script|style|noscript|template)[^>]*>"
TAG = "<[^>]*>"
WEB_ADDRESS = r"https?://[^ \t\n\r\f<>\"'()\[\]]+"
FINAL_MARKS = "[.,;:!?]+$"
CANONICAL = r"(?i)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']+)"
BASE = r"(?i)<base[^>]+href=[\"']([^\"']+)"


def visible_urls(html: Column) -> Column:
    """The distinct web addresses that a page's text shows, sorted; those in attributes and scripts are not shown."""
    shown = F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), TAG, " ")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(shown, F.lit(WEB_ADDRESS), 0), lambda u: F.regexp_replace(u, FINAL_MARKS, ""))))


def declared_url(html: Column) -> Column:
    """The canonical address that a page names, else its base address, else null."""
    named = [F.regexp_extract(html, p, 1) for p in (CANONICAL, BASE)]
    return F.coalesce(*[F.when(n != "", n) for n in named])


def decoded_email(code: Column) -> Column:
    """An e-mail address from pairs of hex digits, of which the first is combined by XOR with all others; anything else stays as it is."""
    pair = lambda i: F.conv(F.substr(code, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
    own = code.rlike("^([0-9A-Fa-f]{2}){2,}$")
    last = F.greatest(F.lit(2), F.floor(F.char_length(code) / 2).cast("int"))
    return F.when(own, F.array_join(F.transform(F.sequence(F.lit(2), last), lambda i: F.char(pair(i).bitwiseXOR(pair(F.lit(1))))), "")).otherwise(code)


def retry_after(value: Column, now_s: int, most: float = 3600.0) -> Column:
    """Seconds to wait by a Retry-After header, a number or an HTTP date, between 0 and ``most``; null where it is neither."""
    plain = F.trim(value)
    day = F.concat(F.regexp_extract(plain, r"^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", 1), F.lit(" +0000"))
    seconds = F.when(plain.rlike("^[0-9]+$"), plain.try_cast("double")).otherwise(F.unix_timestamp(F.try_to_timestamp(day, F.lit("dd MMM yyyy HH:mm:ss xx"))).cast("double") - now_s)
    return F.least(F.lit(most), F.greatest(F.lit(0.0), seconds)) * F.when(seconds.isNotNull(), 1.0)


def backoff_ceiling(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """The longest delay before an attempt counted from 0; the delay itself is a uniform share of it."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))
