"""Range-aggregate operators as DataFrame jobs."""
