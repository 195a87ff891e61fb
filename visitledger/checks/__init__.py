"""Runnable queries over the shared tables, each paired with a SQL cross-check where SQL can express it."""

from visitledger.checks import merging, operations, patients, productivity, revenue, scalars, storage  # noqa: F401
from visitledger.checks.registry import CHECKS

__all__ = ["CHECKS"]
