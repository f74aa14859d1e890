"""Query catalogues: name -> (spark, directory) -> DataFrame."""
