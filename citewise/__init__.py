"""citewise: analytics over AI answers, search data and web pages, built on Spark SQL."""
