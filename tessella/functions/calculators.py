"""Admission merit, grade averages, fees and acceptance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of entry test, second and first certificate; totals where none is given; bonus marks.
SHARES = (0.33, 0.50, 0.17)
TOTALS = (400, 550, 1100)
BONUS = 20
# Tuition by programme and category, and the other dues of a term.
TUITION = {("engineering", "subsidized"): 48000, ("engineering", "other"): 135000, ("computing", "subsidized"): 52000, ("computing", "other"): 145000}
POSTGRADUATE = 65000
EXAM, LIBRARY, ADMISSION, SECURITY = 12500, 4500, 25000, 15000
HOSTEL, HOSTEL_SECURITY, TRANSPORT = 16000, 10000, 14000


def _total(given: Column, usual: int) -> Column:
    return F.when(given > 0, given).otherwise(F.lit(usual))


def merit(test: Column, test_total: Column, second: Column, second_total: Column, first: Column, first_total: Column, bonus: Column) -> dict[str, Column]:
    """aggregate (0 to 100), and eligibility for engineering and computing, from marks and totals; bonus adds 20 to the second certificate."""
    t, s, f = _total(test_total, TOTALS[0]), _total(second_total, TOTALS[1]), _total(first_total, TOTALS[2])
    more = F.when(bonus, BONUS).otherwise(0)
    part = lambda marks, of, share: F.greatest(F.lit(0), marks) / of * 100 * share
    whole = part(test, t, SHARES[0]) + part(F.least(second + more, s + more), s, SHARES[1]) + part(first, f, SHARES[2])
    raw = F.greatest(F.lit(0), second) / s * 100
    return {"aggregate": F.least(F.lit(100.0), F.greatest(F.lit(0.0), whole)), "engineering": (raw >= 60) & (test > 0), "computing": (raw >= 50) & (test > 0)}


def marks_needed(estimate: Column, aggregate: Column, share: float, total: Column, usual: int) -> Column:
    """More marks in a part of the aggregate that close the gap to an estimate."""
    return F.greatest(F.lit(0), F.ceil((estimate - aggregate) / (share * 100) * _total(total, usual)))


def grade_average(points: Column, credits: Column) -> Column:
    """The average of grade points by credits over a group, 0 without credits."""
    return F.when(F.sum(credits) > 0, F.sum(points * credits) / F.sum(credits)).otherwise(0.0)


def standing(gpa: Column, credits: Column) -> dict[str, Column]:
    return {"probation": (gpa < 2.0) & (credits > 0), "dean_list": (gpa >= 3.7) & (credits >= 12)}


def cumulative(gpa: Column, credits: Column, before: Column, before_credits: Column) -> Column:
    return F.when(credits + before_credits > 0, (before * before_credits + gpa * credits) / (credits + before_credits)).otherwise(gpa)


def target(aim: Column, total: Column, now: Column, done: Column) -> dict[str, Column]:
    """remaining credits, required average over them, and whether it can be had."""
    left = F.greatest(F.lit(0), total - done)
    need = F.when(left > 0, (aim * total - now * done) / left).otherwise(0.0)
    return {"remaining": left, "required": need, "status": F.when(left <= 0, "completed").when(need > 4.0, "impossible").when(need >= 3.5, "challenging").otherwise("achievable")}


def invoice(programme: Column, category: Column, residence: Column, term: Column) -> dict[str, Column]:
    """tuition, first_dues (admission and deposits of a first term), term (all dues) and four_years."""
    tuition = F.lit(POSTGRADUATE)
    for (name, kind), amount in TUITION.items():
        tuition = F.when((programme == name) & ((category == "subsidized") == F.lit(kind == "subsidized")), amount).otherwise(tuition)
    hostel, first = residence == "hostel", term == "first"
    living = F.when(hostel, HOSTEL).otherwise(TRANSPORT)
    once = F.when(first, ADMISSION + SECURITY + F.when(hostel, HOSTEL_SECURITY).otherwise(0)).otherwise(0)
    later = tuition + EXAM + LIBRARY + living
    return {"tuition": tuition, "first_dues": once, "term": later + once, "four_years": later + once + later * 7}


# The checks of a release, what each is violated by, and its words.
CHECKS = (
    ("NOT workflow_contracts", "Workflow contracts not fully active"),
    ("NOT trace_spans", "Trace spans incomplete"),
    ("NOT deadlines", "Deadlines not bounded"),
    ("NOT kill_switches", "Kill switches missing"),
    ("invalid_documents > 0", "Invalid documents leaked into context"),
    ("unknown_freshness > 0", "Unknown freshness presented as current"),
    ("unresolved_conflicts > 0", "Unresolved conflict presented as current"),
    ("NOT cache_revalidation", "Cache source revalidation disabled"),
    ("NOT stampede_protection", "Cache stampede protection missing"),
    ("injection_pass_rate < 1", "Direct injection pass rate below 100%"),
    ("ssrf_pass_rate < 1", "SSRF pass rate below 100%"),
    ("NOT no_dead_models", "Deprecated or dead model IDs remain in registry"),
    ("NOT dimension_validated", "Embedding 768-dimension invariant violated"),
    ("recall_at_k < 0.95", "High-current Recall@10 below 95%"),
    ("unsupported_rate > 0", "Unsupported critical claims detected"),
    ("citation_correctness < 1", "Citation correctness below 100%"),
    ("p95_ms > 8000", "p95 latency exceeds 8s"),
    ("cache_hit_p95_ms > 1500", "Cache hit p95 latency exceeds 1.5s"),
)
COUNTED = 16


def acceptance() -> dict[str, Column]:
    """violations, accepted and score of a row that has the columns that ``CHECKS`` name; the score is over 16 though there are 18 checks."""
    said = [F.when(F.expr(rule), F.lit(words)) for rule, words in CHECKS]
    violations = F.filter(F.array(*said), lambda x: x.isNotNull())
    return {"violations": violations, "accepted": F.size(violations) == 0, "score": (COUNTED - F.size(violations)) / COUNTED * 100}
