"""Analytics over semi-structured documents and ordered sequences, on the DataFrame and SQL API."""
