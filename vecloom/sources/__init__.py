"""Readers and writers of vector files, datasets and generators."""
