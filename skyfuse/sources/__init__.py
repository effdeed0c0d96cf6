"""Readers and writers of features, poses, prompts, logs and reports."""
