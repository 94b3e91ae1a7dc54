"""functions of quirework."""
