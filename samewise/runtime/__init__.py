"""Limits on requests and resources of a driver process."""
