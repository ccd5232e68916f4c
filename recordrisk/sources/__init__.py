"""Readers, writers and the views the queries start from."""
