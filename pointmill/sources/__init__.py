"""Readers and writers of clouds and skeletons."""
