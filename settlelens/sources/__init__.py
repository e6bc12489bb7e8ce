"""Readers for raw snapshots, registries, chain tables and manifests."""
