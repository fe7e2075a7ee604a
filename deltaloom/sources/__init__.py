"""Registered tables' files, the change log and manifests."""
