"""Readers and writers: tables, nested facts JSON, filing index and filing text, metrics."""
