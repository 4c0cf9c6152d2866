"""The queries of the training-data operators, and SQL for those that SQL can express."""

from siltstone.llm import codes, decontaminate, digests, langid, licenses, lmscore, mixing, negatives, personal, setjoin, token_files, tokens, topk

MODULES = (setjoin, lmscore, langid, mixing, topk, licenses, decontaminate, tokens, token_files, personal, digests, codes, negatives)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()}
