"""edgeloom: sketches, clusters and anomaly scores for streams of typed graph edges, on Spark."""
