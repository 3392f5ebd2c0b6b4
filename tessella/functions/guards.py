"""Screens of questions and documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARACTERS = 2000
# Patterns, in any case, of questions that try to instruct the system.
NOUNS = "(?:instructions?|rules|prompts?|guidelines|directives)"
INJECTION = (
    rf"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+{NOUNS}",
    r"(?:^|\n)\s*(?:system|role)\s*:",
    r"\[INST\]",
    r"<\/s>",
    r"<\|im_(?:start|end)\|>",
    r"###\s*[Ii]nstruction",
    r"<\s*script[\s>]",
    r"from\s+now\s+on\s*,?\s+(?:you\s+(?:are|will|must)|act\s+as|respond\s+as|ignore)",
    r"you\s+are\s+now\s+(?:an?\s+)?(?:unrestricted|jailbroken|dan\b|evil|uncensored)",
    rf"disregard\s+(?:all\s+|any\s+|the\s+|your\s+)*(?:previous\s+|prior\s+|above\s+|earlier\s+|system\s+)?{NOUNS}",
    rf"override\s+(?:all\s+|any\s+|the\s+|your\s+)*(?:system\s+|safety\s+)?{NOUNS}",
    rf"do\s+not\s+follow\s+(?:the\s+|your\s+|any\s+)*(?:system\s+|previous\s+)?{NOUNS}",
)
# The gateway's own patterns.
GATEWAY = (
    r"ignore\s+(previous|above)\s+instructions",
    r"system\s+prompt\s+override",
    r"you\s+are\s+now\s+in\s+developer\s+mode",
    r"reveal\s+your\s+instructions",
    r"bypass\s+(security|policy|rules)",
    r"<script[\s\S]*?>[\s\S]*?<\/script>",
)
# Terms for which a short document is kept.
HIGH_VALUE = ("admission", "deadline", "eligibility", "fee", "merit list", "notice", "result", "schedule", "scholarship", "seat allocation", "tcat", "ecat")
LEAST_WORDS = 8
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def suspicious(text: Column) -> Column:
    return text.rlike("(?i)" + any_of(INJECTION))


# Fixed value: the characters of a question at most.
QUESTION_CHARACTERS = 2000


def question_screen(text: Column, most: int = QUESTION_CHARACTERS) -> Column:
    """invalid (null or empty), too long, injection or ok: what a question is turned away for, in this order."""
    return F.when(text.isNull() | (text == ""), "invalid").when(F.char_length(text) > most, "too long").when(suspicious(text), "injection").otherwise("ok")


def gateway(text: Column) -> Column:
    """OK, or why a request is turned away: empty, too long, or holding a pattern once control characters are gone."""
    plain = F.trim(F.regexp_replace(text, CONTROL, ""))
    return (
        F.when(text.isNull() | (F.trim(F.regexp_replace(text, r"\s", " ")) == ""), "EMPTY_INPUT")
        .when(F.char_length(text) > MOST_CHARACTERS, "REQUEST_LENGTH_EXCEEDED")
        .when(plain.rlike("(?i)" + any_of(GATEWAY)), "PROMPT_INJECTION_DETECTED")
        .otherwise("OK")
    )


def kept_though_short(url: Column, title: Column, text: Column, words: Column) -> Column:
    """Whether a document below the least word count stays: eight words or more and a term of value."""
    everything = F.lower(F.concat_ws(" ", url, title, text))
    hit = F.lit(False)
    for term in HIGH_VALUE:
        hit = hit | F.contains(everything, F.lit(term))
    return (words >= LEAST_WORDS) & hit


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


# Words of questions, by what they make of them.
PAST = ("historical", "previous year", "past")
CURRENT_RISK = ("fee", "deadline", "closing date", "merit", "entry test", "admission schedule", "eligibility", "date sheet")
ROMAN_URDU = ("kya", "kab", "kaise", "hai")
PAST_YEAR = r"\b(19[0-9][0-9]|20[0-1][0-9]|202[0-4])\b"
FACULTY, STAFF, ADMIN = ("faculty", "professor", "dr.", "prof."), ("staff",), ("admin", "head", "registrar", "chancellor")


def understanding(text: Column) -> dict[str, Column]:
    """language, intent, temporal_intent, risk, requested_year and facts of a question."""
    low = F.lower(text)
    past = low.rlike(PAST_YEAR) | _any(low, PAST)
    high = ~past & _any(low, CURRENT_RISK)
    year = F.regexp_extract(low, PAST_YEAR, 1)
    fact = lambda hit, *names: F.when(hit, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    return {
        "language": F.when(text.rlike("[؀-ۿ]"), "urdu").when(_any(low, ROMAN_URDU), "roman_urdu").otherwise("english"),
        "intent": F.when(past, "historical").when(_any(low, ("fee",)), "fees").when(_any(low, ("merit",)), "merit").when(_any(low, ("entry test", "ecat")), "entry_test").when(_any(low, ("admission",)), "admissions").when(_any(low, ("exam", "date sheet")), "examinations").otherwise("general"),
        "temporal_intent": F.when(past, "historical").when(high, "current").otherwise("timeless"),
        "risk": F.when(past, "historical").when(high, "high_current").otherwise("general"),
        "requested_year": F.when(year != "", year.cast("int")),
        "facts": F.concat(fact(_any(low, ("fee",)), "fee_amount"), fact(_any(low, ("deadline", "last date")), "deadline"), fact(_any(low, ("merit",)), "merit_value"), fact(_any(low, ("entry test", "exam")), "entry_test_date", "exam_date")),
    }


def confidence_tier(n: Column, top: Column) -> Column:
    """refuse without results, else hedge, cite or normal by the best score."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "refuse").when(top < 0.4, "hedge").when(top < 0.6, "cite").otherwise("normal")


def person_type(url: Column, title: Column) -> Column:
    both = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))
    return F.when(_any(both, FACULTY), "faculty").when(_any(both, STAFF), "staff").when(_any(both, ADMIN), "admin")


def of_session(session: Column, wanted: str) -> Column:
    """Facts of a session, or of none."""
    return session.isNull() | (session == wanted)


# Months by name.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def currency(text: Column) -> Column:
    """The digits of an amount in rupees, or null."""
    found = F.regexp_extract(text, r"(?i)(?:PKR|Rs\.?|Rupees)\s*([0-9,]+)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")))


def date(text: Column) -> Column:
    """A day as YYYY-MM-DD, from that form or from "31 July 2026", or null."""
    named = rf"(?i)([0-9]{{1,2}})\s+({'|'.join(MONTHS)})\s+([0-9]{{4}})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, named, 2)))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(F.trim(text).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.trim(text)).when(month > 0, F.concat_ws("-", F.regexp_extract(text, named, 3), two(month), two(F.regexp_extract(text, named, 1))))


def percentage(text: Column) -> Column:
    """A share with two digits, from "80%" or "0.80", or null."""
    percent, part = F.regexp_extract(text, r"([0-9.]+)\s*%", 1), F.regexp_extract(text, r"0\.[0-9]+", 0)
    shown = lambda x: F.format_string("%.2f", x)
    return F.when(percent != "", shown(percent.try_cast("double") / 100)).when(part != "", shown(part.cast("double")))


def fact_value(kind: Column, text: Column) -> Column:
    """The normalised value of a fact by its kind, or its trimmed text."""
    own = F.when(kind == "fee_amount", currency(text)).when(kind.isin("deadline", "entry_test_date", "exam_date"), date(text)).when(kind.isin("percentage", "merit_value"), percentage(text))
    return F.coalesce(own, F.trim(text))


def pdf_tier(source: Column, title: Column) -> Column:
    """Freshness tier of a PDF by its source and title."""
    both = F.lower(F.concat_ws(" ", source, title))
    return F.when(_any(both, ("admission", "academic", "prospectus", "fee", "schedule")), "high").when(_any(both, ("department", "faculty", "program", "curriculum")), "medium").otherwise("low")


VISUAL = ("picture", "table", "formula", "caption")


def has_markdown_table(text: Column) -> Column:
    """Whether a line with two bars or more is followed by a rule of a table, blank lines left out."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.zip_with(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda a, b: (F.length(F.regexp_replace(a, r"[^|]", "")) >= 2) & b.rlike(r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$"))
    return F.exists(pairs, lambda p: F.coalesce(p, F.lit(False)))


def page_route(text: Column, classes: Column, expected_table: Column, quality: Column, missing: Column, error: Column) -> Column:
    """Why a PDF page needs a second reading, by rules in their order, or 'blank page' or 'fast extraction is usable', which need none."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    visual = F.arrays_overlap(classes, F.array(*map(F.lit, VISUAL)))
    odd = F.length(F.regexp_replace(plain, "[^�]", ""))
    words = F.size(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), 0))
    return (
        F.when(missing, "fast extractor returned no page chunk")
        .when(error.isNotNull(), "fast page extraction failed")
        .when((plain == "") & visual, "empty extraction on a visually substantive page")
        .when(plain == "", "blank page")
        .when((odd >= 3) | (odd / F.greatest(F.lit(1), F.length(plain)) > 0.01), "invalid or unmapped glyphs")
        .when(expected_table & ~has_markdown_table(plain), "table detected but Markdown table was not recovered")
        .when((quality < 0.45) & visual, "low-quality extraction with visual/layout content")
        .when((words < 5) & F.array_contains(classes, "picture"), "sparse extraction from image-heavy page")
        .otherwise("fast extraction is usable")
    )
