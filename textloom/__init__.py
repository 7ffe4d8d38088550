"""textloom: document search, corpus analytics and training-data preparation on Spark."""
