"""Change capture and replay."""
