"""Searches, quantisers, index layouts, ground truth, evaluation and request-log statistics."""
