"""Catalogs kept current by streams."""
