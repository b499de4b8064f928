"""Vellum: plans."""
