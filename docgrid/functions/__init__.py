"""docgrid functions."""
