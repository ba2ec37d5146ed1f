"""Parameterised analyses over the event table and texts."""
