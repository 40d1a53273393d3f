"""Schema drift over streams."""
