"""All queries over the report relations and documents."""

from __future__ import annotations

from . import details, flows, reports, runs, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
