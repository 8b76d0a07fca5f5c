"""Operators over typed tables of attempts, steps and graphs."""
