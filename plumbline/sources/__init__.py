"""Stores, snapshots and catalog inspection."""
