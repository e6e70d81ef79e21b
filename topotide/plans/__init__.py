"""Helpers that shape how plans run: shared scratch tables and iteration."""
