"""lastro: fat-tail analytics, document gates, proof checking and retrieval as Spark plans."""
