"""Streams: evaluation and pairing over files that keep arriving."""
