"""Streaming forms: see ``furniture``, and ``sources.datasource`` for files as they arrive."""
