"""DataFrame operators; column names are keyword arguments."""
