"""lexweave: dictionaries, inflected forms and text corpora on Spark DataFrames."""
