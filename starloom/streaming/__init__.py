"""Order events as streams."""
