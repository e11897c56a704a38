"""Speech-transcript analytics on Spark: scoring, mining, sampling and clustered statistics as DataFrame plans."""
