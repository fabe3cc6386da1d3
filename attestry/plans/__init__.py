"""Declarative recipes and parameter files, compiled to DataFrame plans."""
