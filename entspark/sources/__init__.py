"""Where files, changes, commits and blame come from."""
