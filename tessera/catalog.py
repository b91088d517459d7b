"""All registered queries of the library, by name, with their SQL."""

from __future__ import annotations

from tessera.plans import charts, detail, fees, inclusion, incremental, leaders, lookup, maintenance, records, replay, spec

QUERIES = leaders.QUERIES | charts.QUERIES | records.QUERIES | detail.QUERIES | lookup.QUERIES | inclusion.QUERIES | fees.QUERIES | maintenance.QUERIES | replay.QUERIES | incremental.QUERIES | spec.QUERIES
ORACLES = leaders.ORACLES | charts.ORACLES | records.ORACLES | detail.ORACLES | lookup.ORACLES | inclusion.ORACLES | fees.ORACLES | maintenance.ORACLES | replay.ORACLES | incremental.ORACLES | spec.ORACLES
