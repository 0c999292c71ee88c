"""Operators over fact and data tables."""
