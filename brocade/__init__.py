"""brocade: listing-page analytics expressed as Spark DataFrame plans."""
