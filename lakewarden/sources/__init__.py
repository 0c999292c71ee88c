"""Readers that turn scripts, catalogues and corpora into tables."""
