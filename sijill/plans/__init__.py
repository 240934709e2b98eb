"""Whole jobs: files → tables, tables → exports, catalogue, harvest run."""
