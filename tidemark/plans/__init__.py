"""Registered queries over the test tables and their SQL."""

from tidemark.plans import algebra, models, rules, scans, services, streams  # noqa: F401
from tidemark.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
