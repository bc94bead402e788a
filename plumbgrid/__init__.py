"""plumbgrid: point-cloud, capture-sequence and match-graph analytics expressed as Spark DataFrame operators."""
