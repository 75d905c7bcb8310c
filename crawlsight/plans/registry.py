"""Loads every registry module."""

from __future__ import annotations

from crawlsight.plans import registry_links, registry_pages, registry_projects, registry_rest, registry_scores, registry_sites, registry_tools  # noqa: F401
from crawlsight.plans.catalog import ORACLES, QUERIES  # noqa: F401
