"""Named queries over the synthetic trace, and the SQL that checks each."""

from . import rules, streams  # noqa: F401  they register their queries
from .queries import ORACLES, QUERIES, relay_latency

__all__ = ["ORACLES", "QUERIES", "relay_latency"]
