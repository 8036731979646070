"""DataFrame operators on entities, changes and edges."""
