"""Pages without running lines and page numbers, against a plain version."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import furniture

WORD = re.compile(r"[^\W_]+(?:[’'\-][^\W_]+)*")
EXPLICIT = re.compile(r"\s*(?:[#>*_`~-]+\s*)*(?:page|pg\.?|p\.)\s*[:#-]?\s*\d{1,6}(?:\s*(?:of|/|\\)\s*\d{1,6})?(?:\s*[#>*_`~-]+)*\s*", re.I)
ARABIC = re.compile(r"\s*(?:[*_`#~-]+\s*)*([0-9]{1,6})(?:\s*(?:of|/|\\)\s*([0-9]{1,6}))?(?:\s*[*_`#~-]+)*\s*", re.I)
ROMAN = re.compile(r"\s*(?:[*_`#~-]+\s*)*([ivxlcdm]{2,8})(?:\s*[*_`#~-]+)*\s*", re.I)
HEADING = re.compile(r"\s{0,3}#{1,6}\s+")


def shown(line):
    out = line.strip()
    for _ in range(3):
        m = re.fullmatch(r"(?:\*\*|__|~~|`|\*|_)(.*?)(?:\*\*|__|~~|`|\*|_)", out)
        out = m[1].strip() if m else out
    return HEADING.sub("", out, count=1).strip()


def key(line):
    plain = re.sub(r"\s+", " ", shown(line).lower()).strip()
    for pattern, by in ((r"(?i)(?:page|pg\.?)\s*[:#-]?\s*\d{1,6}(?:\s*(?:of|/)\s*\d{1,6})?\s*$", ""), (r"(?<!\d)\d{1,4}\s*(?:of|/)\s*\d{1,6}\s*$", "")):
        m = re.search(pattern, plain)
        if m:
            return re.sub(r"\s+", " ", (plain[: m.start()] + " <page>").strip())
    m = re.search(r"([|:–—-])\s*\d{1,4}\s*$", plain)
    if m and not HEADING.match(line.strip()):
        return re.sub(r"\s+", " ", plain[: m.start()] + m[1] + " <page>")
    return plain


def candidate(line):
    s, v = line.strip(), shown(line)
    words = WORD.findall(v)
    if not s or furniture_placeholder(s) or s.count("|") >= 2 or re.match(r"(?:>\s?|[-+*]\s+|\d{1,4}[.)]\s+|!\[|\[[^\]]+\]:)", s) or re.fullmatch(r"(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})", s):
        return False
    if not v or len(v) > 80 or not 1 <= len(words) <= 12 or v.endswith((".", "?", "!", ";")) or not any(c.isalpha() for c in v):
        return False
    return not HEADING.match(s) or running(v)


def running(v):
    words, letters = WORD.findall(v), [c for c in v if c.isalpha()]
    if re.search(r"(?i)https?://|www\.|\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b", v) or EXPLICIT.fullmatch(v):
        return True
    return len(words) >= 2 and bool(letters) and (sum(c.isupper() for c in letters) / len(letters) >= 0.7 or (len(words) >= 3 and sum(w[:1].isupper() for w in words) / len(words) >= 0.8))


def furniture_placeholder(s):
    return bool(re.fullmatch(r"(?i)(?:==>\s*)?(?:picture|image|figure)\s*(?:\[\d+ x \d+\])?\s*(?:intentionally\s+)?(?:omitted)?\s*(?:<==)?", s)) and bool(re.search(r"(?i)omitted|==>|<==|\d+ x \d+", s))


def value_of(line):
    m = ARABIC.fullmatch(line)
    if m:
        v = int(m[1])
        return None if 1800 <= v <= 2200 and m[2] is None else v
    m = ROMAN.fullmatch(line)
    if not m:
        return None
    total = last = 0
    for c in reversed(m[1].lower()):
        v = furniture.ROMAN_DIGITS[c]
        total += -v if v < last else v
        last = max(last, v)
    return total


def clean(pages):
    """Cleaned texts of the pages of one document."""
    records = []
    for p, text in enumerate(pages):
        fenced, page = False, []
        for line in (text or "").split("\n"):
            mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
            protected = fenced or bool(mark)
            fenced ^= bool(mark)
            if protected or not furniture_placeholder(line.strip()):
                page.append({"page": p, "line": line, "protected": protected, "edge": None, "outer": False})
        content = [r for r in page if r["line"].strip() and not r["protected"]]
        w = min(4, max(1, math.ceil(len(content) / 4)))
        for i, r in enumerate(content):
            r["edge"] = "top" if i < w else "bottom" if i >= len(content) - w else None
            r["outer"] = i in (0, len(content) - 1)
        records.append(page)
    full = sum(any(r["edge"] for r in page) for page in records)
    need = max(3, math.ceil(round(full * 0.6, 9))) if full < 9 else max(9, math.ceil(round(full * 0.35, 9)))
    seen = defaultdict(set)
    for r in (r for page in records for r in page if r["edge"] and candidate(r["line"])):
        seen[r["edge"], key(r["line"])].add(r["page"])
    heads = {k for (_, k), on in seen.items() if len(on) >= need and k} if full >= 3 else set()
    numbers = set()
    for edge in ("top", "bottom"):
        own = [(r["page"], value_of(r["line"])) for page in records for r in page if r["edge"] == edge and r["outer"] and not r["protected"] and value_of(r["line"]) is not None]
        values = [v for _, v in own]
        steps = sum(0 < b - a <= 3 for a, b in zip(values, values[1:], strict=False))
        up = len(set(values)) >= 3 and steps >= max(1, math.ceil(round((len(values) - 1) * 0.6, 9)))
        as_page = max(sum(v == p + 1 for p, v in own), sum(v == p for p, v in own)) >= math.ceil(round(len(own) * 0.8, 9))
        if len(own) >= 2 and (up or as_page):
            numbers.add(edge)
    out = []
    for page in records:
        kept = []
        for r in page:
            line = r["line"] if r["protected"] else r["line"].rstrip()
            if not r["protected"] and line.strip() and (key(line) in heads or EXPLICIT.fullmatch(line) or (r["outer"] and r["edge"] in numbers and value_of(line) is not None)):
                continue
            if line or r["protected"] or not kept or kept[-1][0] or kept[-1][1]:
                kept.append((line, r["protected"]))
        out.append("\n".join(x for x, _ in kept).strip())
    return out


def made(draw):
    n = draw.choice([1, 2, 3, 5, 8, 9, 14])
    head = draw.choice([None, "ANNUAL REPORT 2024", "**The Big Journal** page {p}", "# A Title Of Things", "## plain heading", "see www.example.com", "Report | {p}", "Chapter {p}", "prose that ends."])
    foot = draw.choice([None, "{p}", "- {p} -", "{r}", "Page {p} of 99", "1999", "{p}/20", "{odd}"])
    pages = []
    for p in range(n):
        body = [draw.choice(["", "word " * draw.randint(1, 20), f"Line {draw.randint(0, 10**6)} of it", "| a | b |", "- item", "42", "iv", "==> picture [3 x 4] intentionally omitted <==", "```\nPage 7\n\n\n```", "Same Line Here"]) for _ in range(draw.randint(0, 25))]
        put = lambda t: t.format(p=p + 1, r=["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv"][p], odd=draw.randint(0, 400))
        lines = ([put(head)] if head and draw.random() < 0.9 else []) + body + ([put(foot)] if foot and draw.random() < 0.9 else [])
        pages.append("\n".join(lines))
    return pages


def test_pages_as_by_a_plain_version(spark):
    draw = random.Random(12)
    documents = [made(draw) for _ in range(200)] + [["", None, ""], [None]]
    rows = [(d, p, t) for d, pages in enumerate(documents) for p, t in enumerate(pages)]
    pages = spark.createDataFrame(rows, "document long, page int, text string").repartition(5)
    found = {(r.document, r.page): r.text for r in furniture.cleaned_pages(pages).collect()}
    want = {(d, p): t for d, texts in enumerate(documents) for p, t in enumerate(clean(texts))}
    assert {k: (found.get(k), t) for k, t in want.items() if found.get(k) != t} == {}
    assert sum(len(a or "") for _, _, a in rows) > sum(map(len, found.values())) + 1000


def test_cleaning_twice_changes_nothing_more(spark):
    words = random.Random(4)
    body = lambda: "\n".join(" ".join(words.choice(["alpha", "beta", "gamma", "delta"]) + str(words.randint(0, 9999)) for _ in range(14)) for _ in range(24))
    rows = [(d, p, f"UNIVERSITY NEWS | {p + 1}\n\n{body()}\n\n\n{p + 3}") for d in range(6) for p in range(11)]
    once = furniture.cleaned_pages(spark.createDataFrame(rows, "document long, page int, text string"))
    assert {r.removed for r in once.collect()} == {2}
    again = furniture.cleaned_pages(once.drop("removed"))
    assert sorted(map(tuple, once.drop("removed").collect())) == sorted(map(tuple, again.drop("removed").collect())) and {r.removed for r in again.collect()} == {0}


@pytest.mark.parametrize(("text", "value"), [("iv", 4), ("XIV", 14), ("mcmxc", 1990), ("ii", 2)])
def test_roman_numbers(spark, text, value):
    assert spark.range(1).select(furniture.roman(F.lit(text))).first()[0] == value


def test_documents_of_pages(spark):
    pages = spark.createDataFrame([(1, 1, "two words"), (1, 0, "one " * 9), (1, 2, " "), (2, 0, "a b")], "document long, page int, text string")
    titles = spark.createDataFrame([(1, "First"), (2, "Second")], "document long, title string")
    found = {r.document: r for r in furniture.assembled(pages, titles).collect()}
    assert found[1].text == "# First\n\n## Page 1\n\n" + "one " * 9 + "\n\n## Page 2\n\ntwo words" and found[1].pages == 3 and found[1].usable and not found[2].usable
    assert [r[0] for r in spark.createDataFrame([(1,), (5,), (40,)], "n int").select(furniture.least_words(F.col("n"))).collect()] == [8, 20, 50]
    assert [r[0] for r in spark.createDataFrame([(5,), (20,), (100,)], "n long").select(furniture.required(F.col("n"))).collect()] == [3, 9, 35]
