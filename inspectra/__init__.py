"""Inspectra: employment-record compliance analytics and corpus preparation on Spark."""
