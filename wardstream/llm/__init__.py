"""Operators for training-data work on texts and records; nothing outside this folder imports it."""
