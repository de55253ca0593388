"""Importing this module registers every query."""

from ledgerloom.plans import (  # noqa: F401
    cell_queries,
    descriptor_queries,
    extended_queries,
    history_queries,
    identity_queries,
    normalize_queries,
    portfolio_queries,
    project_queries,
    rules_queries,
    source_queries,
    streaming_queries,
    text_queries,
)
