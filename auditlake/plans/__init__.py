"""Whole commands: reports in print, the run from input to outputs, and files that change hands with checks."""
