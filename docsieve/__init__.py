"""Quality checks for data extracted from documents, as Spark DataFrame operators."""
