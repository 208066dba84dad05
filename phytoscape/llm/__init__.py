"""Operators for large training sets: similar vectors, clusters, canonical names, packing, leakage, splitting."""
