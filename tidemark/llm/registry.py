"""The queries of this subpackage by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tidemark.llm import decontaminate, hnsw, katz, langid, licenses, mixing, secrets, simhash, substring, warc

MODULES = (simhash, hnsw, mixing, decontaminate, langid, substring, licenses, katz, secrets, warc)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in getattr(m, "SQL", {}).items()}
