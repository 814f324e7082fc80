"""Relational operators over pixels, palettes and file collections."""
