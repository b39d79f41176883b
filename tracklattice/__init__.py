"""Catalogue resolution and similarity engine built on the DataFrame API."""
