"""Daily values and grid cells of unbounded streams."""
