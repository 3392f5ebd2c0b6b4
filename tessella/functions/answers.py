"""What an answering run decides at its steps, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The states of a run, and reasons of its steps.
STATES = ("security_checked", "classified", "evidence_evaluated", "generation_allowed", "completed")
FINAL = {"abstain": "abstained", "refuse": "refused"}
SUCCESS, KILLED, UNVERIFIED = "WORKFLOW_SUCCESS", "Phase {} killed by emergency switch.", "unknown"
RISKS = {"high": "high_current", "medium": "medium_current", "low": "low_current"}


def _some(value: Column) -> Column:
    """A text, or null if it is empty."""
    return F.when(value != "", value)


def best_content(parent: Column, dense: Column, text: Column, chunk: Column, contextual: Column, summary: Column) -> Column:
    """What stands for a hit: its parent's text, else what the channel of the highest precedence that found it has, with the summary before it.

    The channels' columns are null where a channel did not find the hit.  A
    vector hit's parts (an array) are joined by lines, and one without parts
    is passed over; an empty text of another channel is what there is.
    """
    base = F.coalesce(_some(parent), F.array_join(dense, "\n"), text, chunk, contextual, F.lit(""))
    return F.when((F.coalesce(summary, F.lit("")) != "") & (base != ""), F.concat(F.lit("Context: "), summary, F.lit("\n\n"), base)).when(base != "", base).otherwise(F.coalesce(summary, F.lit("")))


def evidence_input(risk: Column, official: Column, state: Column, applicability: Column) -> Column:
    """query_risk, temporal_intent, authority, freshness_state and applicability: a question's risk and one of its results as the evidence gate takes them."""
    named = reduce(lambda c, item: F.when(risk == item[0], item[1]).otherwise(c), list(RISKS.items())[:2], F.lit(RISKS["low"]))
    return F.struct(
        named.alias("query_risk"), F.when(risk.isin("high", "medium"), "current").otherwise(UNVERIFIED).alias("temporal_intent"),
        F.when(official, "official_primary").otherwise(UNVERIFIED).alias("authority"), F.when(state.isin("fresh", "aged"), state).otherwise(UNVERIFIED).alias("freshness_state"),
        F.when(applicability == "current", applicability).otherwise(UNVERIFIED).alias("applicability"),
    )


def violated(checks: list[tuple[Column, str]], phase: str, killed: Column | None = None) -> Column:
    """The message of the first check of a phase that is not met, null if all are; a check that can't be told is not met."""
    found = [F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in checks]
    stopped = [F.when(F.coalesce(killed, F.lit(False)), KILLED.format(phase))] if killed is not None else []
    return F.coalesce(*stopped, *found, F.lit(None).cast("string"))


def workflow(gateway: Column, decision: Column, reason: Column) -> Column:
    """final_state, decision, reason and states of a run: turned away at the gate (gateway is its reason unless OK), stopped by the evidence, or completed."""
    refused = gateway != "OK"
    stopped = decision.isin(*FINAL)
    final = F.when(refused, "refused").when(stopped, reduce(lambda c, item: F.when(decision == item[0], item[1]).otherwise(c), FINAL.items(), F.lit(None).cast("string"))).otherwise(STATES[-1])
    states = F.when(refused, F.array(F.lit("refused"))).when(stopped, F.concat(F.array(*map(F.lit, STATES[:3])), F.array(final))).otherwise(F.array(*map(F.lit, STATES)))
    return F.struct(final.alias("final_state"), F.when(refused, "refuse").otherwise(decision).alias("decision"), F.when(refused, gateway).otherwise(reason).alias("reason"), states.alias("states"))


def routed(kind: Column, value: Column, context: Column) -> Column:
    """action (clear, failure or nothing), job, url, document and generation of a chunk's result.

    value (null for a failure that reports nothing) and context are structs of
    job, url, document, generation; value also has success and rag_id.  What
    the chunk reports of itself goes before what its batch was sent with.
    """
    own = lambda name: F.coalesce(F.when(kind == "success", value[name]), context[name])
    url, document = own("url"), own("document")
    done = (kind == "success") & F.coalesce(value["success"], F.lit(False)) & (F.coalesce(value["rag_id"], F.lit("")) != "") & (F.coalesce(url, F.lit("")) != "")
    action = F.when(done, "clear").when((F.coalesce(url, F.lit("")) != "") & document.isNotNull(), "failure").otherwise("nothing")
    return F.struct(action.alias("action"), own("job").alias("job"), url.alias("url"), document.alias("document"), own("generation").alias("generation"))


def page_unresolved(error: Column, missing: Column, fast_error: Column, read_again: Column, table_missing: Column, empty: Column, quality: Column, visual: Column) -> Column:
    """Whether a PDF page needs another reading; its own errors count unless it was ``read_again``."""
    return error.isNotNull() | ((missing | fast_error.isNotNull()) & ~read_again) | table_missing | (visual & (empty | (quality < 0.35)))
