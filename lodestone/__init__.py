"""Retrieval, grounding and corpus operators as DataFrame-to-DataFrame functions on Spark."""
