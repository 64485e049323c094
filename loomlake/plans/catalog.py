"""Names of all queries of the core, and their SQL counterparts."""

from __future__ import annotations

from loomlake.plans import corpus, evaluation, integrity, retrieval, samples, sources, streams  # noqa: F401
from loomlake.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "run_summary"
