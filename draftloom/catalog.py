"""All operators of the library, by name."""

from __future__ import annotations

from .functions import geometry, text  # noqa: F401
from .operators import aggregates, joins, windows  # noqa: F401
from .plans import objects, reports, rooms, solvers, stages, structure, topology, walls  # noqa: F401
from .sources import sinks  # noqa: F401
from .streaming import arrivals  # noqa: F401
from .operators.registry import COVERS, ORACLES, QUERIES, apply

__all__ = ["COVERS", "ORACLES", "QUERIES", "apply"]
