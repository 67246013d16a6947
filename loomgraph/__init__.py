"""A property-graph engine on Spark DataFrames: corpora become nodes and edges, questions become queries over them."""
