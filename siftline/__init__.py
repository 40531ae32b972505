"""A lexical search engine on Spark: chunked text, an inverted index, BM25 and what surrounds them."""
