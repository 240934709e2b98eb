"""The recurring harvest over newly landed files."""
