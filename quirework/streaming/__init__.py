"""streaming of quirework."""
