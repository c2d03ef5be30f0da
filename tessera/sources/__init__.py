"""Readers: repositories, ignore rules, Java sources, settings."""
