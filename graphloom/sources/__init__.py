"""Where corpora, histories, suites and graph views come from."""
