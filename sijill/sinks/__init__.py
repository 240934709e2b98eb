"""Writers of the open-data files."""
