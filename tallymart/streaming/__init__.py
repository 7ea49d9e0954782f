"""Structured Streaming jobs: JSON messages to hourly tables in the lake."""
