"""webloom: web-corpus processing (links, crawl graphs, media, rewriting) on Spark DataFrames."""
