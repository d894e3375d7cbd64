"""skein: link-graph crawl analytics as Spark DataFrame plans."""
