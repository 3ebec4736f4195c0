"""Importing this package registers every query."""

from . import discovery, events, files, market, policy, rules, scenarios, shape  # noqa: F401
from .registry import CATALOG

__all__ = ["CATALOG"]
