"""All registered queries and their SQL."""

from __future__ import annotations

from siltstone.plans import changes, evaluation, freshness, grounding, identity, interactions, links, locators, logs, markdown, pages, parsing, predicates, ranking, records, retrieval, reviews, rules, scopes, sinks, traces, transcripts

AREAS = (retrieval, grounding, changes, parsing, rules, logs, evaluation, interactions, predicates, traces, reviews, records, links, scopes, freshness, identity, pages, markdown, transcripts, sinks, ranking, locators)
QUERIES: dict = {name: query for area in AREAS for name, query in area.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
