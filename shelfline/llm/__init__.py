"""Training-data operators on documents, embeddings and conversations.

One module per operator; ``queries`` holds the registered queries and their
oracle SQL.  Nothing else in the library imports this subpackage.
"""
