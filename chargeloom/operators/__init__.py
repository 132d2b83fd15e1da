"""Operators on tables of stations, windows, predictions and clients."""
