"""Training-data operators: cleaning, mixing, deduplication, tokenising and classifying whole corpora.

Each module holds one operator with its general interface; ``queries`` derives the registered
``opN_<name>`` results from them and ``oracle`` states those that SQL can express.
"""
