"""Driver-side objects that compile to DataFrame plans, and the query registry."""
