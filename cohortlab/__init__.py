"""Cohort preparation, model selection, evaluation and explanation as Spark jobs."""
