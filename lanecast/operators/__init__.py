"""Parameterised DataFrame operators; each module covers one part of the analysis."""
