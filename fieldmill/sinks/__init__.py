"""Writers and their encodings."""
