"""All core queries in one registry."""

from __future__ import annotations

from tidemark.plans import extras, forecasts, history, inference, intake, models, problems, records, registry

REGISTRY = registry.new()
for module in (problems, history, forecasts, records, extras, models, inference, intake):
    for name, f in module.R.queries.items():
        REGISTRY.query(name, module.R.oracles.get(name))(f)
