"""Column expressions: polynomials, certificates, rectangles, statistics."""
