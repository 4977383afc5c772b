"""Cleaning large collections of Markdown notes and their images with Spark."""
