"""Structured Streaming jobs over score requests and the prediction log."""
