"""Every core query by name, with the SQL it is checked against."""

from __future__ import annotations

from . import arrays, changes, corpus, evaluation, objectives, pools, rollout

MODULES = (changes, evaluation, corpus, rollout, objectives, pools, arrays)
FLAGSHIP = "a3_classification_report"
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
