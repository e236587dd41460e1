"""Index and search operators as DataFrame plans."""
