"""angleweave: Spark-native analytics over sequences of angle pairs on a torus."""
