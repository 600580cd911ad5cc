"""treeblock: hierarchical documents and n-d arrays as Spark DataFrames."""
