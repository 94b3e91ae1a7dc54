"""plans of quirework."""
