"""tessera: entity resolution, text cleaning, vector search and reporting as Spark plans."""
