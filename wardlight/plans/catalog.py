"""All named queries, collected from the thematic modules."""

from __future__ import annotations

from wardlight.plans import (  # noqa: F401
    auditing, featuring, learning, parsing, scoring, streamed, visiting)
from wardlight.plans.registry import ORACLES, QUERIES
from wardlight.plans.scoring import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
