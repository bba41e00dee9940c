"""lathe: Spark jobs for text corpora, skill records and evaluation analytics."""
