"""Whole jobs built from the operators, and the physical helpers they share."""
