"""Part of the timed-text analytics engine."""
