"""Queries that apply the operators to the test tables, with their SQL.

The tables stand in for video archives: a vector row is a frame, an order's line
is a detected object, a document is a line of text or speech, an event is a
moment. Each query runs over its whole tables.
"""

from __future__ import annotations

from . import exploration, extras, files, ranking, relations, reports, searches, sequences, texts

QUERIES = {k: v for m in (ranking, relations, sequences, texts, reports, exploration, files, searches, extras) for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in (ranking, relations, sequences, texts, reports, exploration, files, searches, extras) for k, v in m.ORACLE.items()}
