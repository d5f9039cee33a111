"""Importing this package registers every query."""

from loomcast.plans import models, prep, studies, validation, windowing  # noqa: F401
from loomcast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
