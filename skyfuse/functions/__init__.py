"""Column functions: boxes, rings, photogrammetry, scores, names."""
