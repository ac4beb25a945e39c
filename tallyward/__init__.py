"""Part of the catalog audit engine."""
