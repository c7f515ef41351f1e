"""Approximate range aggregates and corpus operators, declared as Spark jobs."""
