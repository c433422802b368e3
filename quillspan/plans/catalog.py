"""All queries over the driver tables outside the training-data operators."""

from quillspan.plans import hierarchy, retrieval, signals, telemetry  # noqa: F401  they register themselves
from quillspan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
