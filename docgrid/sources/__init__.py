"""docgrid sources."""
