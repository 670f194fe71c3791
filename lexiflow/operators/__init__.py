"""DataFrame operators: lexicon, search, review replay, plans, statistics, event sync, library."""
