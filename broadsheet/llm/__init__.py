"""Operators for text corpora that models are trained on."""
