"""operators of the quern engine."""
