"""Code and document corpora, training pairs, retrieval and its evaluation, as Spark plans."""
