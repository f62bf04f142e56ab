"""Whole jobs, built from the operators: datasets, embedding runs and probe sweeps."""
