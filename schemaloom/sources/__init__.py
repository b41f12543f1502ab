"""Readers of project metadata and the writers of finished models."""
