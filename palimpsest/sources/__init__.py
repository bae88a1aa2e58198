"""Reading and writing versioned tables."""
