"""Reading and writing: raw text, tables, artifacts, digests and provenance."""
