"""Operators: plain functions from DataFrame to DataFrame."""
