"""Measurement evidence as DataFrame programs."""
