"""Readers for event text, schema dumps and log segments."""
