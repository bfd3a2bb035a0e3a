"""Report relations, end-to-end plans and the query registry."""
