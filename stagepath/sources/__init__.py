"""Readers and writers for event logs."""
