"""Composed plans: inputs derived from plain tables, end-to-end pipelines, registered queries."""
