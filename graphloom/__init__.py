"""graphloom: a message archive becomes a queryable knowledge graph, on Spark DataFrames."""
