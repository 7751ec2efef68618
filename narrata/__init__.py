"""narrata: text corpora, narration timelines and job logs as Spark DataFrames."""
