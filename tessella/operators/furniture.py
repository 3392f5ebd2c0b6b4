"""Running heads, feet and page numbers over the pages of documents.

Pages are rows (document, page, text).  Lines get their place on the page;
what stands at the same edge of enough pages of a document is furniture, and
so are numbers at the outer edge that count up with the pages.  A page is
looked at by itself; what is gathered over a document is a count for each
line, and a row for each number at an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.furniture_forms import ARABIC, CONTACT, DELIMITER, FENCE, HEADING, MARKER, NUMBER_BEHIND, NUMBER_BEHIND_MARK, PAGE_LABEL, PLACEHOLDER, PLACEHOLDER_SIGN, ROMAN, ROMAN_DIGITS, RULE, SIZES_ALONE, STRUCTURE, WORD

# Lines looked at from either edge, characters and words of a running line at most, pages for which the share holds, and that share.
EDGE, MOST_CHARACTERS, MOST_WORDS, LEAST_PAGES, SHARE, SMALL_SHARE = 4, 80, 12, 9, 0.35, 0.60


def roman(text: Column) -> Column:
    """The value of Roman digits; a smaller one before a larger is taken away."""
    values = F.transform(F.reverse(F.split(F.lower(text), "")), lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ROMAN_DIGITS.items() for x in pair]), c), F.lit(0)))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))

    def add(s: Column, v: Column) -> Column:
        less = v < s["last"]
        return F.struct((s["sum"] + F.when(less, -v).otherwise(v)).alias("sum"), F.when(less, s["last"]).otherwise(v).alias("last"))

    return F.aggregate(values, start, add, lambda s: s["sum"])


def visible(line: Column) -> Column:
    """A line without emphasis around the whole of it and without the marks of a heading."""
    out = F.trim(line)
    for _ in range(3):
        out = F.trim(F.regexp_replace(out, r"^(?:\*\*|__|~~|`|\*|_)(.*?)(?:\*\*|__|~~|`|\*|_)$", "$1"))
    return F.trim(F.regexp_replace(out, HEADING, ""))


def running_key(line: Column) -> Column:
    """What lines that differ in their page number only have in common."""
    plain = F.trim(F.regexp_replace(F.lower(visible(line)), r"\s+", " "))
    numbered = F.trim(F.regexp_replace(plain, NUMBER_BEHIND, " <page>"))
    marked = F.when(F.trim(line).rlike(HEADING), plain).otherwise(F.regexp_replace(plain, NUMBER_BEHIND_MARK, "$1 <page>"))
    return F.regexp_replace(F.when(numbered != plain, numbered).otherwise(marked), r"\s+", " ")


def placeholder(line: Column) -> Column:
    """Whether a line only stands for a picture that was left out."""
    return line.rlike(SIZES_ALONE) | (line.rlike(PLACEHOLDER) & line.rlike(PLACEHOLDER_SIGN))


def running_matter(shown: Column) -> Column:
    """Whether a line looks like a running title: an address, a page label, capitals, or three words that begin with them."""
    found = F.regexp_extract_all(shown, F.lit(WORD), F.lit(0))
    letters, capitals = (F.char_length(F.regexp_replace(shown, p, "")) for p in (r"[^\p{L}]", r"[^\p{Lu}]"))
    titled = F.size(F.filter(found, lambda w: w.rlike(r"^\p{Lu}") & w.rlike(r"\p{L}"))) / F.size(found)
    by_case = (F.size(found) >= 2) & (letters > 0) & ((capitals / letters >= 0.70) | ((F.size(found) >= 3) & (titled >= 0.80)))
    return shown.rlike(CONTACT) | shown.rlike(PAGE_LABEL) | by_case


def may_run(line: Column) -> Column:
    """Whether a line can be a running one: short, no table, list, prose or bare number; a heading only if it looks like running matter."""
    text, shown = F.trim(line), visible(line)
    n = F.size(F.regexp_extract_all(shown, F.lit(WORD), F.lit(0)))
    refused = (text == "") | placeholder(text) | text.rlike(MARKER) | text.rlike(RULE) | text.rlike(DELIMITER) | (F.size(F.split(text, r"\|")) > 2) | text.rlike(STRUCTURE)
    plain = (shown != "") & (F.char_length(shown) <= MOST_CHARACTERS) & (n >= 1) & (n <= MOST_WORDS) & ~shown.rlike("[.?!;]$") & shown.rlike(r"\p{L}")
    return ~refused & plain & (~text.rlike(HEADING) | running_matter(shown))


def lines(pages: DataFrame) -> DataFrame:
    """document, page, at, line, fenced, place (from 0, of lines with something on them and not fenced), of (how many), edge of every line but placeholders."""
    cut = pages.select("document", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\n")).alias("at", "line"))
    within = Window.partitionBy("document", "page").orderBy("at")
    fence = F.col("line").rlike(FENCE).cast("int")
    marked = cut.withColumn("fenced", (F.sum(fence).over(within) % 2 == 1) | (fence == 1)).where(~placeholder(F.col("line")) | F.col("fenced"))
    content = (F.trim("line") != "") & ~F.col("fenced")
    whole = Window.partitionBy("document", "page")
    counted = marked.withColumn("_c", content).withColumn("place", F.when(F.col("_c"), F.sum(F.col("_c").cast("int")).over(within) - 1)).withColumn("of", F.sum(F.col("_c").cast("int")).over(whole))
    window = F.least(F.lit(EDGE), F.greatest(F.lit(1), F.ceil(F.col("of") / 4).cast("int")))
    edge = F.when(F.col("place") < window, "top").when(F.col("place") >= F.col("of") - window, "bottom")
    return counted.withColumn("edge", edge).drop("_c")


def required(pages: Column) -> Column:
    """On how many pages of a document a running line must be."""
    share = lambda s: F.ceil(F.round(pages * s, 9)).cast("long")
    return F.when(pages < LEAST_PAGES, F.greatest(F.lit(3), share(SMALL_SHARE))).otherwise(F.greatest(F.lit(LEAST_PAGES), share(SHARE)))


def running_keys(placed: DataFrame) -> DataFrame:
    """document and key of the running lines of documents of three pages or more."""
    full = placed.where("of > 0").groupBy("document").agg(F.countDistinct("page").alias("pages")).where("pages >= 3")
    candidates = placed.where(F.col("edge").isNotNull() & may_run(F.col("line"))).select("document", "page", "edge", running_key(F.col("line")).alias("key"))
    counts = candidates.where("key <> ''").distinct().groupBy("document", "edge", "key").agg(F.count("*").alias("n"))
    return counts.join(full, "document").where(F.col("n") >= required(F.col("pages"))).select("document", "key").distinct()


def number_runs(placed: DataFrame) -> DataFrame:
    """document and edge where numbers alone at the outer edge are page numbers.

    Either three different ones, most of which are one to three above the one
    before, or most of them the number of their page, counted from 0 or 1.
    """
    outer = placed.where(F.col("place").isNotNull() & ((F.col("place") == 0) | (F.col("place") == F.col("of") - 1)))
    number, total = F.regexp_extract("line", ARABIC, 1), F.regexp_extract("line", ARABIC, 2)
    arabic = F.when(number != "", number.cast("int"))
    year = arabic.between(1800, 2200) & (total == "")
    letters = F.regexp_extract("line", ROMAN, 1)
    value = F.when(arabic.isNotNull(), F.when(~year, arabic)).when(letters != "", roman(letters))
    found = outer.select("document", "page", "at", "edge", value.alias("value")).where("value IS NOT NULL AND edge IS NOT NULL")
    order = Window.partitionBy("document", "edge").orderBy("page", "at")
    step = F.col("value") - F.lag("value").over(order)
    stepped = found.withColumn("step", step.between(1, 3).cast("int"))
    runs = stepped.groupBy("document", "edge").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("distinct"), F.coalesce(F.sum("step"), F.lit(0)).alias("steps"),
        F.sum((F.col("value") == F.col("page") + 1).cast("int")).alias("from_one"), F.sum((F.col("value") == F.col("page")).cast("int")).alias("from_nought"),
    )
    counts_up = (F.col("distinct") >= 3) & (F.col("steps") >= F.greatest(F.lit(1), F.ceil(F.round((F.col("n") - 1) * 0.60, 9))))
    as_pages = F.greatest("from_one", "from_nought") >= F.ceil(F.round(F.col("n") * 0.80, 9))
    return runs.where((F.col("n") >= 2) & (counts_up | as_pages)).select("document", "edge")


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """document, page, text and removed (lines) of every page, without furniture; runs of blank lines become one.

    pages: document, page (from 0, in order), text.  Fenced code stays as it
    is; a document of fewer than three pages loses page numbers only.  Pages
    that lose all have an empty text; null texts are empty.
    """
    placed = lines(pages)
    keyed = placed.withColumn("key", running_key(F.col("line")))
    runs = running_keys(placed).withColumn("_running", F.lit(True))
    numbers = number_runs(placed).withColumn("_numbers", F.lit(True))
    joined = keyed.join(runs, ["document", "key"], "left").join(numbers, ["document", "edge"], "left")
    outer = F.col("place").isNotNull() & ((F.col("place") == 0) | (F.col("place") == F.col("of") - 1))
    bare = F.col("line").rlike(ARABIC) | F.col("line").rlike(ROMAN)
    year = F.regexp_extract("line", ARABIC, 1).rlike("^(1[89][0-9]{2}|2[01][0-9]{2}|2200)$") & (F.regexp_extract("line", ARABIC, 2) == "")
    numbered = F.col("_numbers").isNotNull() & outer & bare & ~year
    gone = ~F.col("fenced") & (F.trim("line") != "") & (F.coalesce("_running", F.lit(False)) | F.col("line").rlike(PAGE_LABEL) | numbered)
    row = F.struct("at", F.when(F.col("fenced"), F.col("line")).otherwise(F.regexp_replace("line", r"\s+$", "")).alias("line"), "fenced")
    held = joined.groupBy("document", "page").agg(F.sort_array(F.collect_list(F.when(~gone, row))).alias("rows"), F.sum(gone.cast("int")).alias("removed"))  # the lines of a page
    kept = F.filter("rows", lambda r, i: r["fenced"] | (r["line"] != "") | (i == 0) | (F.get("rows", i - 1)["line"] != "") | F.get("rows", i - 1)["fenced"])
    text = F.regexp_replace(F.array_join(F.transform(kept, lambda r: r["line"]), "\n"), r"^\s+|\s+$", "")
    out = pages.select("document", "page").join(held.select("document", "page", text.alias("text"), "removed"), ["document", "page"], "left")
    return out.select("document", "page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("removed", F.lit(0)).alias("removed"))


def least_words(pages: Column) -> Column:
    """How many words a document of so many pages must have to be worth taking: four a page, from 8 to 50."""
    return F.least(F.lit(50), F.greatest(F.lit(8), pages * 4))


def assembled(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """document, text, pages, words and usable of each document: its title (of titles: document, title) and the pages that say something, under their numbers."""
    section = F.when(F.trim("text") != "", F.concat(F.lit("## Page "), (F.col("page") + 1).cast("string"), F.lit("\n\n"), F.col("text")))
    held = pages.groupBy("document").agg(F.count("*").alias("pages"), F.sort_array(F.collect_list(F.when(section.isNotNull(), F.struct("page", section.alias("section"))))).alias("s"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.col("title"))), F.transform("s", lambda x: x["section"])), "\n\n")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return held.join(titles, "document").select("document", text.alias("text"), "pages").withColumn("words", words).withColumn("usable", F.col("words") >= least_words(F.col("pages")))
