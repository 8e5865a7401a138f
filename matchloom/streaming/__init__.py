"""Prediction over arriving files."""
