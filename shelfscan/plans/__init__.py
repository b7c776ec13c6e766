"""Prepared tables and the named queries built on them."""
