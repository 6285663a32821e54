"""loomwork: document retrieval and corpus analytics written on PySpark DataFrames."""
