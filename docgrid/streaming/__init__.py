"""docgrid streaming."""
