"""All registered queries of this subpackage, the pipeline included."""

import corpus_pipeline
from pagewright.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE = {**queries.ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
