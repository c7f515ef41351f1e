"""Whole queries: answer from a synopsis, certify, refine what is not certified, measure."""
