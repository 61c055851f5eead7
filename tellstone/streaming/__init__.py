"""Streams: corrections and counts that follow new files."""
