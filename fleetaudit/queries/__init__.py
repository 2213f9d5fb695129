"""All named queries; importing the modules registers them."""

from . import findings, functions, history, rules, streams, tables  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
