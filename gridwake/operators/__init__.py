"""Relational forms of slicing, regridding, stencils and interpolation."""
