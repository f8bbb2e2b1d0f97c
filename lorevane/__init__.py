"""lorevane: document retrieval, link, grid and conversation operators written as Spark plans."""
