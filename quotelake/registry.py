"""All registered queries of the library proper, with their SQL."""

from __future__ import annotations

from quotelake.plans import corpora, detection, engine, history, live, queue, references, retrieval, search, sessions, speech, stores, texts

_MODULES = (history, texts, retrieval, detection, sessions, references, speech, queue, corpora, search, live, engine, stores)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
