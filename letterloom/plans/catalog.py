"""All registered queries; importing the modules registers them."""

from letterloom.plans import bodies, calendar, ingest, messages, people, rendering, state, streams, threads
from letterloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bodies", "calendar", "ingest", "messages", "people", "rendering", "state", "streams", "threads"]
