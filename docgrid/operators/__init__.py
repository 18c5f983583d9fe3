"""docgrid operators."""
