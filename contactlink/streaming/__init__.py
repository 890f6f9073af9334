"""Contact files as they arrive."""
