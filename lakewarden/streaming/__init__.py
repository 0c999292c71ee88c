"""Streaming views of the audit log."""
