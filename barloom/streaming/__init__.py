"""Streaming forms of the bar aggregation, the regime switch and the exit monitor."""
