"""Registry of the engine's queries and of the SQL that says the same."""

from __future__ import annotations

import chronoweave.plans.algorithm_queries  # noqa: F401
import chronoweave.plans.comparison_queries  # noqa: F401
import chronoweave.plans.file_queries  # noqa: F401
import chronoweave.plans.graph_queries  # noqa: F401
import chronoweave.plans.history_queries  # noqa: F401
import chronoweave.plans.reply_queries  # noqa: F401
import chronoweave.plans.report_queries  # noqa: F401
import chronoweave.plans.sample_queries  # noqa: F401
import chronoweave.plans.structure_queries  # noqa: F401
import chronoweave.plans.text_queries  # noqa: F401
import chronoweave.plans.vector_queries  # noqa: F401
from chronoweave.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "a29_retrieval_metrics"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
