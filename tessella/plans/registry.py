"""Collects the queries of every family."""

from __future__ import annotations

from . import answers, comparisons, crawling, indexes, knowledge, maintenance, operations, pages, policies, relational, retrieval, streams, texts, upkeep
from .pairs import Query

FAMILIES = [retrieval.FAMILY, policies.FAMILY, texts.FAMILY, operations.FAMILY, relational.FAMILY, crawling.FAMILY, knowledge.FAMILY, maintenance.FAMILY, streams.FAMILY, indexes.FAMILY, pages.FAMILY, comparisons.FAMILY, answers.FAMILY, upkeep.FAMILY]
QUERIES: dict[str, Query] = {name: query for family in FAMILIES for name, query in family.queries.items()}
ORACLE: dict[str, str] = {name: text for family in FAMILIES for name, text in family.oracle.items()}
