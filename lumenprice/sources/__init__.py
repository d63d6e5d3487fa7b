"""File formats, format detection and decoding to cells."""
