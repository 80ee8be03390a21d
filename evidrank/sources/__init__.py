"""Readers for delimited and JSON sources, declared schemas, and stage tables with their ledgers."""
