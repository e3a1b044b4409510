"""Readers and writers: raw recordings, caches, telemetry."""
