"""Vellum: operators."""
