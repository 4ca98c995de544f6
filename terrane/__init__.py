"""Interval, signal-profile and read-depth analytics expressed as Spark plans."""
