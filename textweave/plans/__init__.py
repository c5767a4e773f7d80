"""Jobs composed of several operators."""
