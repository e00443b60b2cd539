"""Filters, neighbours, clusters, identities, tracks and frames."""
