"""docgrid plans."""
