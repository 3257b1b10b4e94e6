"""trellis: property-graph pattern queries and training-data operators on PySpark DataFrames."""
