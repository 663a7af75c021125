"""All queries of the engine but those of the optional subpackage."""

from . import catalog, evaluation, ingesting, library, parsing, passes, payloads, retrieval, services, streams, texts  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
