"""Recurring friction in recorded work sessions, as Spark plans."""
