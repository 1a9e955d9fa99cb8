"""All registered queries of the package itself."""

from __future__ import annotations

from . import changes, entities, geo, jobs, monitoring, parsing, places, quality_metrics, scoring, sinks, spam, streams, text, web
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "changes", "entities", "geo", "jobs", "monitoring", "parsing", "places", "quality_metrics", "scoring", "sinks", "spam", "streams", "text", "web"]
