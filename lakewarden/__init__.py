"""A governed data estate on Spark: catalog, profiles, masks, reviews, scores and ledgers as DataFrame jobs."""
