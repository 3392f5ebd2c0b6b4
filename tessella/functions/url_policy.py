"""One form for each URL: scheme, host, port, path and query normalised; what is refused becomes empty."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST, MOST_QUERY = 2048, 40
# Query keys that only track visitors.
TRACKING = re.compile(r"^(utm_.*|fbclid|gclid|ref|sessionid|phpsessid|jsessionid)$", re.I)
PORTS = {"http": 80, "https": 443}
_SAFE = "/-._~!$&'()*+,;=:@"


def normalize(url: str | None) -> str:
    """Lower-case scheme and host in ASCII, no default port, no fragment, resolved dots, sorted distinct query without tracking keys."""
    text = re.sub(r"[\x00-\x20\x7f]", "", url or "")
    if not text or len(text) > MOST:
        return ""
    try:
        parts = urlsplit(text)
        scheme, host, port = parts.scheme.lower(), (parts.hostname or "").rstrip("."), parts.port
        host = host.encode("idna").decode().lower() if host and ":" not in host else host
    except (ValueError, UnicodeError):
        return ""
    if scheme not in PORTS or not host or parts.username is not None:
        return ""
    shown = f"[{host}]" if ":" in host else host
    where = shown if port in (None, PORTS[scheme]) else f"{shown}:{port}"
    path = quote(unquote(parts.path or "/"), safe=_SAFE)
    slash = path.endswith("/")
    path = posixpath.normpath(re.sub("/+", "/", path))
    path = "/" if path in (".", "/", "//") else path + ("/" if slash else "")
    query = sorted({(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not TRACKING.match(k)})
    if len(query) > MOST_QUERY:
        return ""
    return urlunsplit((scheme, where, path, urlencode(query), ""))


@F.pandas_udf(StringType())
def canonical(urls: pd.Series) -> pd.Series:
    return urls.map(normalize)
