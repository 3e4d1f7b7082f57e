"""loomline: typed-decision corpora prepared and analysed with Spark DataFrames."""
