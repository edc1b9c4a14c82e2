"""Training-data operators: extraction, filtering, near duplicates, scoring, mixing and search.

Nothing outside this folder imports it; ``queries`` holds the registered queries and their SQL.
"""
