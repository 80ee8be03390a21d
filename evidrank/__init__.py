"""Evidence ranking on Spark: score, combine, rank and validate entities from incomplete evidence tables."""

__version__ = "0.1.0"
