"""functions of the quern engine."""
