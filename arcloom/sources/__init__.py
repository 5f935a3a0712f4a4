"""Readers, writers and keyed table maintenance."""
