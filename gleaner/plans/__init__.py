"""All modules of registered queries."""

from . import account_queries, card_queries, catalog, cleaning_queries, collection_queries, event_queries, file_queries, request_queries  # noqa: F401
