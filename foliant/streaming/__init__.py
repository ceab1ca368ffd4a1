"""The operators as streams."""
