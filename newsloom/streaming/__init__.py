"""Continuous ingest, and windows over event time."""
