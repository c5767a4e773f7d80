"""Column-to-Column functions; all but stemming and vector dot products are native."""
