"""Readers, writers and the shared-storage staging helper."""
