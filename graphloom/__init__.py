"""graphloom: a knowledge-graph memory and text-corpus engine on Spark DataFrames."""
