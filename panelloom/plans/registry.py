"""All named queries on the driver's tables, with their SQL."""

from __future__ import annotations

from panelloom.plans import archive_queries, dispatch_queries, european_queries, forecast_queries, inference_queries, panel_queries, portfolio_queries, robustness_queries, source_queries, store_queries, study_queries
from panelloom.plans.book import Book

_BOOKS: list[Book] = [panel_queries.BOOK, store_queries.BOOK, dispatch_queries.BOOK, portfolio_queries.BOOK, inference_queries.BOOK, study_queries.BOOK, robustness_queries.BOOK, source_queries.BOOK, archive_queries.BOOK, european_queries.BOOK, forecast_queries.BOOK]
QUERIES = {name: q for b in _BOOKS for name, q in b.queries.items()}
ORACLE_SQL = {name: q for b in _BOOKS for name, q in b.sql.items()}
flagship = panel_queries.flagship
