"""Column functions: geometry over vertex arrays, text harmonization, scores and decision rules."""
