"""Readers and writers: source trees, history, manifests, feeds and the scan store."""
