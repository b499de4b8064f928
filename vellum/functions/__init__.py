"""Vellum: functions."""
