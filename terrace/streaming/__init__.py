"""Scoring of streams and requests."""
