"""Question-bank analytics on Spark: ordered document blocks in, audited question records out."""
