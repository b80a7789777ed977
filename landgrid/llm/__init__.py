"""Training-data operators: near and exact dedup, archives, chat formatting, tokens, language, toxicity, packing.

Nothing outside this subpackage imports it; ``landgrid.llm.queries`` lists its queries and oracle SQL.
"""
