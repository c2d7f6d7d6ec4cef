"""Catalog phases, validation and reports, built from the operators."""
