"""Canonical model, grammar and validation: everything before a DataFrame exists."""
