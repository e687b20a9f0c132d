"""DataFrame operators by topic."""
