"""Continuous forms of the interval operators and of event windows."""
