"""Corvane: code-audit analytics and corpus preparation as Spark plans."""
