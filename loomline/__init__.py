"""Analytics over workflow and retrieval state, as Spark DataFrame functions."""
