"""Credit-graph analytics over catalogues of releases, people and labels, on Spark."""
