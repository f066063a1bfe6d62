"""DataFrame-to-DataFrame operators, each with explicit keys."""
