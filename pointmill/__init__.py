"""Point-cloud analytics and training-data preparation as PySpark DataFrames."""
