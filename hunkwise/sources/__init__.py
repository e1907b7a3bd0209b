"""Where diffs come from, and where results go."""
