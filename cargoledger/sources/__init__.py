"""Scans and parsing of inputs."""
