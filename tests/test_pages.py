"""Addresses that ask for a change, and the links and images that pages keep, against plain versions."""

import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import candidates, urls


def layered(text, layers):
    for _ in range(layers):
        text = "".join(f"%{b:02X}" for b in text.encode()) if "%" not in text else text.replace("%", "%25")
    return text


def test_layers_of_escapes(spark):
    rows = [(k, f"https://a.b/x/{layered('delete', k)}/y") for k in range(8)]
    found = {r.k: (r.text, r.asks) for r in spark.createDataFrame(rows, "k int, u string").select("k", urls.decoded(F.col("u")).alias("text"), urls.changes_something(F.col("u")).alias("asks")).collect()}
    assert [found[k][0] for k in range(8)] == ["https://a.b/x/delete/y"] * 5 + [None] * 3
    assert all(asks for _, asks in found.values())


@pytest.mark.parametrize(
    ("url", "asks"),
    [
        ("https://a.b/deleted-records-policy", False), ("https://a.b/resetting-your-password-guide", False), ("https://a.b/Account/LogOut", True), ("https://a.b/x_reset.php", True),
        ("https://a.b/?action=reset-all", True), ("https://a.b/?action=RESET", False), ("https://a.b/?x=delete", False), ("https://a.b/?delete", False), ("https://a.b/?delete=", False), ("https://a.b/?delete=0", True),
        ("https://a.b/?LOGOUT=1", True), ("https://a.b/?op=a+purge", True), ("https://a.b/#delete", False), ("https://a.b?do=submit", True), ("https://a.b/50%/%zz", False), ("", False), (None, None), ("/delete", True),
        ("https://delete.b/", False), ("https://a.b/%E2%28%A1/delete", True),
    ],
)
def test_words_that_ask_for_a_change(spark, url, asks):
    assert spark.createDataFrame([(url,)], "u string").select(urls.changes_something(F.col("u"))).first()[0] == asks


def test_crawl_candidates(spark):
    urls_ = {
        "https://a.b/x": True, "https://c.a.b/x?y=1": True, "http://a.b/x": False, "https://evila.b/x": False, "https://a.b/x.CSS": False, "https://a.b/x.zip;v=1": False, "https://a.b/robots.txt": False,
        "https://a.b/Sitemap.xml/": False, "https://a.b/private/x": False, "https://a.b/logout": False, "https://a.b/x.pdf": True, "ftp://a.b/": False, "https://a.b/only/[x]": True,
    }
    c = urls.crawl_candidate(F.col("u"), (), ("a.b",), (".zip",), exclude=("*/private/*", "https://a.b/odd[0-9]?"))
    assert {r.u: r.c for r in spark.createDataFrame([(u,) for u in urls_], "u string").select("u", c.alias("c")).collect()} == urls_
    assert re.match(urls.glob("a*[!b-c]?.x"), "a__dz.x") and not re.match(urls.glob("a*[!b-c]?.x"), "abz.x")


def reservoir(scores, most):
    """Links kept one after the other; one that scores more takes the place of the one that scores least, the oldest of these."""
    heap, kept = [], set()
    for at, score in enumerate(scores):
        if len(kept) < most:
            kept.add(at)
            heapq.heappush(heap, (score, at))
        elif most and score > heap[0][0]:
            kept.remove(heapq.heappop(heap)[1])
            kept.add(at)
            heapq.heappush(heap, (score, at))
    return sorted(kept)


def test_links_kept_as_by_a_reservoir(spark):
    draw = random.Random(3)
    rows = [(k, [draw.randint(0, 4) for _ in range(draw.choice([0, 1, 3, 8, 30]))]) for k in range(150)]
    scored = F.transform("s", lambda x, i: F.struct(x.alias("score"), i.alias("at")))
    for most in (1, 4, 8):
        table = spark.createDataFrame(rows, "k int, s array<int>")
        found = {r.k: (r.known, r.first) for r in table.select("k", candidates.kept_links(scored, most, F.col("k") >= 0)["at"].alias("known"), candidates.kept_links(scored, most, F.col("k") < 0)["at"].alias("first")).collect()}
        assert found == {k: (reservoir(s, most), list(range(min(most, len(s))))) for k, s in rows}


def test_pages_with_very_many_links(spark):
    html = "".join(f'<a class=x href="/p{k % 60_000}?q={k % 7}">label {k}</a>' for k in range(100_000))
    scored = F.transform(candidates.links(F.col("html"), F.lit("https://a.b/c/d")), lambda x: F.struct((x["at"] % 5).alias("score"), x["at"].alias("at"), x["url"].alias("url")))
    page = spark.createDataFrame([(html,)], "html string").select(candidates.kept_links(scored, 150, F.lit(True)).alias("kept"))
    first = {}
    for k in range(100_000):
        first.setdefault(f"https://a.b/p{k % 60_000}?q={k % 7}", k)
    order = sorted(first.values())
    kept = page.first().kept
    assert [r.at for r in kept] == [order[i] for i in reservoir([at % 5 for at in order], 150)]
    assert "Exchange" not in page._jdf.queryExecution().executedPlan().toString()


def test_links_of_a_page(spark):
    html = "<a href='x.html'>One <b>bold</b></a> <A HREF=\"/y\" title='t'>Two</A> <a href=\"#top\">no</a><a href=\"mailto:a@b\">no</a><a href=\"//h/z\">Three</a><a name=q>no</a><a href='x.html'>again</a>"
    found = spark.createDataFrame([(html,)], "html string").select(candidates.links(F.col("html"), F.lit("https://a.b/c/d")).alias("l")).first().l
    assert [(r.url, r.label) for r in found] == [("https://a.b/c/x.html", "One bold"), ("https://a.b/y", "Two"), ("https://h/z", "Three")]


def test_images_of_a_page(spark):
    html = (
        '<img src="/fee-schedule.png?w=100" alt="Fee"><img src="/fee-schedule.png?w=900" alt="Fee structure" width="900"> caption of it <img src="/logo.png"><img src="/banner.jpg" alt="banner">'
        '<img src="/merit.svg" alt="merit list"><img src="/notice?id=7" alt="image"><img alt="none"><img src="/plain.gif"><img src="/z-ad.gif" class="icon" role="presentation">'
    )
    images = candidates.best_images(F.col("html"), F.lit("https://A.b/"), F.lit(True))
    found = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(images.alias("i")).collect()
    assert [(r.url, r.label) for r in found[0].i][:2] == [("https://A.b/fee-schedule.png?w=900", "Fee structure"), ("https://A.b/notice?id=7", "notice")]
    assert {r.url for r in found[0].i} == {"https://A.b/fee-schedule.png?w=900", "https://A.b/notice?id=7", "https://A.b/plain.gif"} and found[2].i == []
    many = "".join(f'<img src="/notice{k:02}.png">' for k in range(30))
    found = spark.createDataFrame([(many,)], "html string").select(images.alias("i")).first().i
    assert [r.url[-6:-4] for r in found] == [f"{k:02}" for k in range(8)]
