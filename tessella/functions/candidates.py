"""The best links and images of a page, chosen within its row: no page's links are exploded or shuffled."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import percent_decoded

MOST_LINKS, MOST_IMAGES = 150, 8
ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*')[^>]*>.*?</a\s*>"
IMAGE = r"(?is)<img\b[^>]*>[^<]*"
# Extensions of images, and of those that an image reader takes.
IMAGE_KINDS = ("avif", "bmp", "gif", "heic", "heif", "jpeg", "jpg", "jxl", "png", "svg", "tif", "tiff", "webp")
READABLE_KINDS = tuple(k for k in IMAGE_KINDS if k not in ("jxl", "svg"))
# Query parameters that only transform an image.
TRANSFORMS = ("w", "width", "h", "height", "q", "quality", "fit", "crop", "dpr", "format", "fm", "auto")
# Labels that say nothing, and words of each sign of an image's worth.
PLAIN_LABELS = ("image", "photo", "picture", "main campus", "banner", "advertisement", "ad")
PLAIN_WORDS = ("main campus", "campus hero", "hero image", "site banner")
STRONG = ("advertisement", "prospectus", "fee", "merit", "notice", "schedule", "tcat", "ecat", "technology", "programs")
DECORATIVE = ("campus", "hero", "slider", "carousel", "banner", "background")
PERSONS = ("logo", "avatar", "portrait", "profile", "admissionstaff", "admissioncommitee", "admissioncommittee", "controllerexamoffice", "convenor", "convener", "programmer", "clerk", "attendant")
FILLERS = ("new.gif", "spacer", "bullet", "arrow", "loading", "spinner")
HIGH = ("admission", "admissions", "advertisement", "apply", "deadline", "ecat", "eligibility", "fee", "fees", "merit", "notice", "program", "programs", "prospectus", "schedule", "seat", "tcat", "technology")
LOW = ("avatar", "campus-life", "gallery", "icon", "logo", "portrait", "profile", "staff", "thumbnail")
KNOWN_SITE = ("challan", "date sheet", "result", "tender", "notification", "merit list")
ICON_CLASSES = ("logo", "icon", "avatar", "profile")
REFUSED = -100.0


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value evaluated a single time, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), of), 0)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _count(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("double") for w in words])


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, in either quotes; empty if it has none."""
    pattern = rf"(?is)[\s\"']{name}\s*=\s*"
    double, single = (F.regexp_extract(tag, f"{pattern}{q}([^{q}]*){q}", 1) for q in ('"', "'"))
    return F.when(double != "", double).otherwise(single)


def plain(text: Column) -> Column:
    """Text without tags, its white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def absolute(link: Column, base: Column) -> Column:
    """A link as an address, by that of its page; null for fragments and other schemes."""
    own, link = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//[^/?#]*", 0), F.trim(link)
    folder = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/", 0)
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike("^(?i)https?://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(link.startswith("/"), F.concat(own, link))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(own, F.lit("/"))), link))
    )


def links(html: Column, base: Column) -> Column:
    """The anchors of a page in order: url, label and at (from 0), each URL where it comes first."""
    found = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), lambda a: F.struct(absolute(attribute(a, "href"), base).alias("url"), plain(a).alias("label")))
    some = F.filter(found, lambda x: x["url"].isNotNull())
    placed = F.transform(some, lambda x, i: F.struct(x["url"].alias("url"), i.alias("at"), x["label"].alias("label")))
    once = bound(F.array_sort(placed), lambda by_url: F.filter(by_url, lambda x, i: (i == 0) | (F.get(by_url, i - 1)["url"] != x["url"])))
    return F.array_sort(F.transform(once, lambda x: F.struct(x["at"], x["url"], x["label"])))


def kept_links(scored: Column, most: int = MOST_LINKS, known: Column | None = None) -> Column:
    """Of links in order (structs that begin with score and at) those that a page keeps, in order.

    A page of an unknown site keeps its first ones.  One of a ``known`` site
    lets a link that scores more take the place of one that scores least, of
    these the one kept longest: what stays is every link above a score, and
    of those at it, kept while there was room, the latest.
    """
    first = lambda links: F.slice(links, 1, most)
    if known is None or not most:
        return first(scored)

    def chosen(links: Column) -> Column:
        least = F.get(F.reverse(F.array_sort(F.transform(links, lambda x: x["score"]))), most - 1)
        return bound(least, lambda l: bound(F.filter(links, lambda x: x["score"] >= l), lambda reached: above_and_latest(reached, l)))

    def above_and_latest(reached: Column, least: Column) -> Column:
        there = F.filter(F.slice(reached, 1, most), lambda x: x["score"] == least)
        above = F.filter(reached, lambda x: x["score"] > least)
        latest = bound(there, lambda t: bound(F.greatest(F.lit(most) - F.size(above), F.lit(0)), lambda room: F.slice(t, F.greatest(F.size(t) - room, F.lit(0)) + 1, room)))
        return F.array_sort(F.concat(above, latest), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))

    return bound(scored, lambda links: F.when(known & (F.size(links) > most), chosen(links)).otherwise(first(links)))


def image_path(url: Column) -> Column:
    return percent_decoded(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def _with(items: Column, **made: Callable[[Column], Column]) -> Column:
    """Structs with further fields.  Each call is a pass over the array, so a field is computed once however often later ones use it."""
    # Fields of one call see those that were there before it.
    return F.transform(items, lambda x: reduce(lambda y, field: y.withField(field[0], field[1](x)), made.items(), x))


def image_label(path: Column, *texts: Column) -> Column:
    """The first text that says something, else the first, else the name of the file at ``path``."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", ""), r"[-_]+", " ")
    given = [F.substring(plain(t), 1, 500) for t in (*texts, name)]
    telling = [F.when((t != "") & ~F.lower(t).isin(*PLAIN_LABELS), t) for t in given]
    return F.coalesce(*telling, *[F.when(t != "", t) for t in given], F.lit("Page image"))


def scored_images(items: Column, known: Column) -> Column:
    """Structs of images (url, path, label, context, width, height, classes, hidden) with score: how much an image is likely to say.

    It goes by words of path, label and context, the size and the part in the
    page.  Images of persons and ornaments are refused.
    """
    words = _with(items, p=lambda x: F.lower(x["path"]), lab=lambda x: F.lower(x["label"]))
    joined = _with(words, direct=lambda x: F.concat_ws(" ", x["p"], x["lab"]), everything=lambda x: F.concat_ws(" ", x["p"], x["lab"], F.lower(x["context"])))
    strong = _with(joined, strong=lambda x: _any(x["direct"], STRONG) | x["direct"].rlike(r"(^|[\s_/-])ad([\s_.?/-]|$)"))
    size = lambda v: F.when(v >= 500, 1.5).when(v >= 250, 0.75).when((v > 0) & (v < 80), -4.0).otherwise(0.0)

    def score(x: Column) -> Column:
        ornament = (x["lab"].isin(*PLAIN_LABELS) | _any(x["lab"], PLAIN_WORDS)) & _any(x["p"], DECORATIVE)
        refused = (ornament | _any(x["direct"], PERSONS) | _any(x["direct"], FILLERS)) & ~x["strong"]
        by_words = 4.0 * _count(x["everything"], HIGH) - 5.0 * _count(x["everything"], LOW) + F.when(x["strong"], 6.0).otherwise(0.0) + F.when(known, 5.0 * _count(x["everything"], KNOWN_SITE)).otherwise(0.0)
        by_place = size(x["width"]) + size(x["height"]) - F.when(_any(F.lower(x["classes"]), ICON_CLASSES), 6.0).otherwise(0.0) - F.when(x["hidden"], 4.0).otherwise(0.0)
        by_kind = F.when(_kind(x["path"]).isin(*IMAGE_KINDS), 1.0).otherwise(0.0) + F.least(F.lit(2.0), F.char_length(x["context"]) / 350.0)
        return F.when(refused, REFUSED).otherwise(by_words + by_place + by_kind)

    return _with(strong, score=score)


def _kind(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def image_identity(url: Column) -> Column:
    """An image's address without fragment and parameters that transform it, scheme and host in lower case."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0))
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRANSFORMS))
    return F.concat(host, rest, F.regexp_replace(F.concat(F.lit("?"), F.array_join(pairs, "&")), r"^\?$", ""))


def best_images(html: Column, base: Column, known: Column | None = None, most: int = MOST_IMAGES) -> Column:
    """The images of a page that are likely to say most: url, label and score, by score, address and place.

    Of images that differ in transforms only the best counts, of these the
    first; only what scores above 0 is a candidate.  The text right behind an
    image is its context.
    """
    known = F.lit(False) if known is None else known
    number = lambda t, n: F.coalesce(F.regexp_extract(attribute(t, n), r"^\s*([0-9]{1,6})", 1).try_cast("double"), F.lit(0.0))
    pieces = F.transform(F.regexp_extract_all(html, F.lit(IMAGE), F.lit(0)), lambda piece, at: F.struct(at.alias("at"), F.regexp_extract(piece, r"(?s)^(<[^>]*>)", 1).alias("tag"), plain(F.regexp_replace(piece, r"(?s)^<[^>]*>", "")).alias("context")))
    there = F.filter(_with(pieces, url=lambda x: absolute(attribute(x["tag"], "src"), base)), lambda x: x["url"].isNotNull())
    readable = F.filter(_with(there, path=lambda x: image_path(x["url"])), lambda x: _kind(x["path"]).isin(*READABLE_KINDS, ""))
    told = _with(
        readable,
        label=lambda x: image_label(x["path"], *[attribute(x["tag"], n) for n in ("alt", "title", "aria-label")]),
        width=lambda x: number(x["tag"], "width"),
        height=lambda x: number(x["tag"], "height"),
        classes=lambda x: attribute(x["tag"], "class"),
        hidden=lambda x: (F.lower(attribute(x["tag"], "role")) == "presentation") | (F.lower(attribute(x["tag"], "aria-hidden")) == "true"),
    )
    found = F.transform(scored_images(told, known), lambda x: F.struct(image_identity(x["url"]).alias("identity"), (-x["score"]).alias("least"), x["at"], x["url"], x["label"]))
    best = bound(F.array_sort(found), lambda by_identity: F.filter(by_identity, lambda x, i: (x["least"] < 0) & ((i == 0) | (F.get(by_identity, i - 1)["identity"] != x["identity"]))))
    ranked = F.array_sort(F.transform(best, lambda x: F.struct(x["least"], F.lower(x["url"]).alias("low"), x["at"], x["url"], x["label"])))
    return F.transform(F.slice(ranked, 1, most), lambda x: F.struct(x["url"].alias("url"), x["label"].alias("label"), (-x["least"]).alias("score")))
