"""Progressive sessions over chunk streams."""
