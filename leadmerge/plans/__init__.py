"""Composed jobs: ingest, validation, reading."""
