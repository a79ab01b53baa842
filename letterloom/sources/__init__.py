"""Payloads of providers; importing the package registers all mappers."""

from letterloom.sources import calendars, cards, chat, gmail, graph, notices, tracker

__all__ = ["calendars", "cards", "chat", "gmail", "graph", "notices", "tracker"]
