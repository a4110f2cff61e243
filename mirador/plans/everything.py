"""Import every query module so that the registry is complete."""

from mirador.plans import registry  # noqa: F401
from mirador.plans import oracles  # noqa: F401
from mirador.plans import q_sql  # noqa: F401
from mirador.plans import q_search  # noqa: F401
from mirador.plans import q_vectors  # noqa: F401
from mirador.plans import q_incremental  # noqa: F401
from mirador.plans import q_series  # noqa: F401
from mirador.plans import q_sources  # noqa: F401
from mirador.plans import q_events  # noqa: F401
from mirador.plans import q_stores  # noqa: F401
from mirador.plans import q_streaming  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = oracles.ORACLES
