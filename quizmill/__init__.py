"""quizmill: corpus-scale document-to-assessment analytics on Spark DataFrames."""
