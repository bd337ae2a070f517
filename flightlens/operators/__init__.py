"""DataFrame → DataFrame operators; column names are parameters."""
