"""Vellum: sources."""
