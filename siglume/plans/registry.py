"""Query registry of the signal engine."""

from siglume.plans import check_queries, feature_queries, level_queries, note_queries, scalar_queries, spectral_queries  # noqa: F401  (register their queries)
from siglume.plans.catalog import ORACLE_SQL, QUERIES  # noqa: F401
