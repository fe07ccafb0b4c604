"""Timed-text analytics on Spark: cues, turns, intervals, corpus metrics and streams as DataFrame operations."""
