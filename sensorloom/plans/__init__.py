"""Rendering, prompts, scoring and experiment plans."""
