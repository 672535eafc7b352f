"""Feeds, article files, logs, search results and the registry of sources."""
