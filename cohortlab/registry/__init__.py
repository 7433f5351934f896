"""All registered queries and their SQL counterparts."""

from . import evaluate, explain_views, learn, prep  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
