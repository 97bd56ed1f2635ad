"""Streams of events: recomputing what new files touch, appends that may be repeated, windows, pacing."""
