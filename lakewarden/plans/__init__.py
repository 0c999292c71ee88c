"""Statements: the gate, and what their plans show."""
