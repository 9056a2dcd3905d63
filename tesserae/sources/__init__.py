"""Readers: images, annotations, archives, tables, and the registry of named datasets."""
