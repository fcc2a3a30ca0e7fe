"""Every registered query with its DuckDB SQL."""

from docmeter.plans import accounts, details, retrieval  # noqa: F401  they register their queries
from docmeter.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "h2_hybrid_retrieve"
