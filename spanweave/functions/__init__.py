"""Part of spanweave."""
