"""Vellum: streaming."""
