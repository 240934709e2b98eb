"""Readers of the archive's files; each has a parser over (path, value) rows and a folder reader."""
