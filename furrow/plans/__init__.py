"""Composite jobs: frame analysis, image grouping, winnowing."""
