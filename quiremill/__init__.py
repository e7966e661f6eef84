"""quiremill: document-curation analytics as composable Spark DataFrame operators."""
