"""sources of the quern engine."""
