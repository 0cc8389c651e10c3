"""Queries of problems 5 to 9."""

from __future__ import annotations

from tidemark.llm import queries_corpus, queries_entities, queries_names, queries_toxic
from tidemark.plans import registry

R = registry.new()
for module in (queries_names, queries_entities, queries_corpus, queries_toxic):
    for name, f in module.R.queries.items():
        R.query(name, module.R.oracles.get(name))(f)
