"""All linkage queries and their SQL: importing the modules below registers them."""

from __future__ import annotations

from foliate.plans import pasted, stateful, stored
from foliate.plans.searches import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "pasted", "stateful", "stored"]
