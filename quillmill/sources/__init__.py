"""Readers and the formatters that turn each source into the papers schema."""
