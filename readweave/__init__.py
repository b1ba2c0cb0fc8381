"""readweave: Bayesian read-to-transcript expression analytics as Spark jobs."""
