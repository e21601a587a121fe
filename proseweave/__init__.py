"""proseweave: corpus preparation, sentence distances, semantic density, statistics and
classifier evaluation for collections of short texts, as Spark DataFrame operators."""
