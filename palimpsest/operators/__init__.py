"""What can be done to a versioned table."""
