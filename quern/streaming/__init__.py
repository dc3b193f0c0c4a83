"""streaming of the quern engine."""
