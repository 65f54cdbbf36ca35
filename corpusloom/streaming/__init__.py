"""The per-document operators over streams."""
