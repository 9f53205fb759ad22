"""Readers and writers of flow tables, time slots and manifests."""
