"""tidemark: report analytics and document processing as lazy Spark plans."""
