"""Candidate quality, selection and preference learning as Spark jobs."""

__version__ = "0.1.0"
