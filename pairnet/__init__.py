"""pairnet: scored interaction networks as Spark DataFrame plans."""
