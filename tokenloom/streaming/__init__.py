"""Incremental daily roll-ups over append-only event feeds."""
