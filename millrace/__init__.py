"""millrace: Spark-first analytics for labelled corpora, model outputs, rollouts and rule pools."""
