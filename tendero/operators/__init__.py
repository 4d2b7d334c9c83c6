"""Reports as functions from DataFrames to one DataFrame. None runs a job by itself."""
