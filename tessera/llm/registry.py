"""All queries of the corpus operators, and their SQL where SQL can express them."""

from tessera.llm import alignment, decontamination, html, infilling, jaccard, language, neighbours, packing, quality, scoring, secrets, sharding, urls

MODULES = (jaccard, packing, html, language, sharding, decontamination, quality, scoring, secrets, urls, infilling, neighbours, alignment)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
