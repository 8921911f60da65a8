"""Lynxmark: review-integrity analytics and corpus preparation, expressed as Spark plans."""
