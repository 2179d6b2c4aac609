"""quern: hybrid retrieval, ranking, evaluation and operational analytics as Spark DataFrame programs."""
