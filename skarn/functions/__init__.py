"""Part of skarn; see README.md."""
