"""quern: a PySpark-native analytics engine for retrieval and LLM-operations data."""
