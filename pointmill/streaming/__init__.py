"""Point clouds that arrive as streams."""
