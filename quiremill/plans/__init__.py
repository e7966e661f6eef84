"""All queries of the library, by name."""

from quiremill.plans import audit_queries, document_queries, event_queries, link_queries, page_queries, source_queries, text_queries  # noqa: F401
from quiremill.plans.registry import ALL

__all__ = ["ALL"]
