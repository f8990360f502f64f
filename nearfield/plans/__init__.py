"""Report plans over stored results, and the registry of checked queries."""
