"""Training-data operators: near-duplicates, mixing, chat formatting, tokens, HTML, quality,
sharding, secrets and exact vector search. Nothing outside this folder imports it."""
