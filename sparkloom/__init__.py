"""Evidence-weighted graph analytics, expressed as Spark DataFrame plans."""
