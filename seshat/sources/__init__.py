"""Transcript files and the generation archive."""
