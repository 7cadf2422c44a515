"""Composition of operators into complete jobs, and the catalog of named queries."""
