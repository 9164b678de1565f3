"""All registered queries of the compliance library."""

from __future__ import annotations

from inspectra.operators import anomaly, cleaning, documents, facts, findings, intake, pages, payloads, rules, surface  # noqa: F401
from inspectra.streaming import documents as stream_documents, filings  # noqa: F401
from inspectra.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
