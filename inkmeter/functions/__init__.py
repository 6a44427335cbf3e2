"""Column functions: text segmentation, array statistics and score arithmetic."""
