"""Part of annalist."""
