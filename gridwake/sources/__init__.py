"""Readers, writers and driver-side configuration formats."""
