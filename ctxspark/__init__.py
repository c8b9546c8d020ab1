"""ctxspark: context retrieval, knowledge lifecycle and corpus operators on PySpark."""
