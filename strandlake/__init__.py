"""Interval, signal, alignment and sequence analytics as plain DataFrame functions."""
