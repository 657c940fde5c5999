"""precis: summarization-corpus preparation and scoring as Spark DataFrame jobs.

Sub-packages
------------
functions   Column -> Column text expressions (clean-up, tokens, n-grams) and the
            few per-row helpers that run inside Arrow-batched pandas UDFs.
sources     scans (story files, JSON-lines records, delimited and line files,
            generation logs) and sinks (aligned text export, splits, CSV reports).
operators   DataFrame -> DataFrame operators: corpus parsing, lemmatize, splits,
            ROUGE-N/L/Lsum, bootstrap intervals, corpus BLEU, vocabulary, ids.
plans       end-to-end jobs, the scoring command line and the registered queries.
streaming   incremental ingestion of JSON-lines news records.
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
