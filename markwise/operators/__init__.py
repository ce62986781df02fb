"""Relational operators over images, pixels, descriptors and matches."""
