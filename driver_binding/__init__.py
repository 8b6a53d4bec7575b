"""Binds the driver tables to a catalogue, and states the same answers in SQL."""
