"""Column builders for vectors, keys and encrypted payloads."""
