"""All registered queries for content stores; the modules named here add theirs as they are imported."""

from vellumry.plans import changes, reads, relations, stores, surface  # noqa: F401
from vellumry.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
