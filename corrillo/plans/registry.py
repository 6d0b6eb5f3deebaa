"""All queries over the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from corrillo.plans import activity, patterns, people, sessions, words  # noqa: F401
from corrillo.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

