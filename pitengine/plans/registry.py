"""All named queries of the library, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pitengine.plans import audit, evidence, extract, history, identity, lab, ledger, parsing, product, reports, streams, terminal, values, writes

FAMILIES = (history, ledger, audit, reports, terminal, values, writes, identity, extract, parsing, evidence, product, lab, streams)
QUERIES = {name: run for family in FAMILIES for name, (run, _) in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
