"""Part of the document engine; see README.md."""
