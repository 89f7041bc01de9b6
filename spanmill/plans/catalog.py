"""All registered queries of the library's core, with their SQL."""

from __future__ import annotations

from . import documents, evaluation, inventory, links, scale

_PARTS = (documents, links, evaluation, scale, inventory)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
