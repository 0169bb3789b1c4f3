"""Training-data operators: classifiers, deduplication, decontamination,
tokenisation, language-model scoring, extraction and chat formatting.

Nothing else in the library imports this subpackage.
"""
