"""tokenloom: text segmentation and lexical analytics over Spark DataFrames."""
