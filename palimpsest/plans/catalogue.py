"""All queries of the core, with the SQL twin of each where SQL states it."""

from __future__ import annotations

from palimpsest.plans import aggregates, jobs, lexical, problem3, ranking, storage, surroundings

REGISTRIES = (storage.R, lexical.R, ranking.R, aggregates.R, jobs.R, surroundings.R)

QUERIES = dict(problem3.QUERIES) | {name: f for r in REGISTRIES for name, f in r.queries.items()}
SQL = dict(problem3.SQL) | {name: text for r in REGISTRIES for name, text in r.sql.items()}
