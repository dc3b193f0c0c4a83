"""plans of the quern engine."""
