"""Streams of manifests."""
