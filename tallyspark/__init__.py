"""Receipt analytics as Spark plans: DataFrame and SQL operators over receipt documents, and training-corpus operators in ``llm``."""
