"""tidemark: event projections, offset algebra and journal queries on Spark DataFrames."""
