"""tidemill: web content extraction and crawl analytics on Spark DataFrames."""
