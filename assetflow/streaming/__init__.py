"""Streaming forms of progress and arrivals."""
