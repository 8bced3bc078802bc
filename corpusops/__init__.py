"""corpusops: DataFrame operators for building, auditing and evaluating labelled corpora."""
