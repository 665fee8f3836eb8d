"""Training-data operators on DataFrames. Nothing else in the library imports this subpackage."""
