"""Mobility analytics on Spark: pings to stays, homes, places, segregation and embeddings."""
