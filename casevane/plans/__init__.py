"""Registered queries."""

from . import cases, checking, evidence, ledger, legal, linking, more, relational, searching, sequences, tools, words  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
