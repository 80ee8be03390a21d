"""Whole-run plans, domain presets, and the queries that exercise every operator on the star-schema tables."""
