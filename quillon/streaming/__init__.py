"""Streaming upserts into tables."""
