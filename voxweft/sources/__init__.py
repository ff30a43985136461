"""Readers and writers of manifests, language models and reports."""
