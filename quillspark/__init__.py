"""Content-community analytics as Spark jobs: facts, counters, evidence, retrieval, evaluation."""
